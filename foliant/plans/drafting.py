"""Wording of documents, generators that give several texts, templates over time, and the words of calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import generators, wording
from ..operators import basis, templates
from .derived import PARAMS_CTE, params

_CUT = "substring(line, 1, CAST(2 + idx % 9 AS INT))"
REPEATING = ("doc_id", "idx", f"concat(substring(line, 1, 12), CASE idx % 4 WHEN 0 THEN concat({_CUT}, '，', {_CUT}) WHEN 1 THEN concat({_CUT}, '。', {_CUT}, '；', {_CUT}) WHEN 2 THEN '术后。。术后，' ELSE '。。，' END, CASE WHEN idx % 3 = 0 THEN '， ，' ELSE '，。' END) AS text")


@query("repeated_phrases", f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), t AS (SELECT {', '.join(REPEATING)} FROM r),
w AS (SELECT doc_id, idx, text, 1 AS pos, '' AS done FROM t
 UNION ALL SELECT doc_id, idx, text, CASE WHEN n IS NULL THEN pos + 1 ELSE pos + 2 * n + 1 END, done || CASE WHEN n IS NULL THEN substr(text, pos, 1) ELSE substr(text, pos, n) END
 FROM (SELECT *, list_filter([2, 3, 4, 5, 6, 7, 8], lambda k: pos + 2 * k <= length(text) AND contains('。；，', substr(text, pos + k, 1)) AND substr(text, pos, k) = substr(text, pos + k + 1, k))[1] AS n FROM w WHERE pos <= length(text)))
SELECT doc_id, CAST(idx AS INT) AS idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(done, '术后。*术后', '术后', 'g'), '。{{2,}}', '。', 'g'), '。，', '，', 'g'), '，。', '，', 'g'), '，\\s*，', '，', 'g') AS text FROM w WHERE pos > length(text)""")
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (idx, line)").selectExpr(*REPEATING)
    return rows.withColumn("text", wording.without_repeats(F.col("text")))


_SAID = "concat(CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), CASE WHEN o_orderkey % 13 = 0 THEN 'X日' ELSE '日' END)"
_KIN = "CASE o_custkey % 5 WHEN 0 THEN '患者本人' WHEN 1 THEN '系患者之子' WHEN 2 THEN '患者母亲' WHEN 3 THEN '系配偶' END"
_DATA = "CASE o_orderkey % 4 WHEN 0 THEN '{\"case_type\": \"death\", \"plaintiffs\": [], \"defendants\": null, \"adm_info\": 1, \"medical_process\": {\"result\": 1}, \"result\": 1, \"court\": \"\"}' WHEN 1 THEN '{\"case_type\": 1, \"plaintiffs\": 2, \"adm_info\": {\"defendants\": 1}}' WHEN 2 THEN 'none' ELSE '{}' END"
_IN_WORDS = lambda c: f"CASE WHEN {c} < 10 THEN substr('〇一二三四五六七八九', {c} + 1, 1) WHEN {c} < 40 THEN substr('十二三', {c} // 10, 1) || CASE WHEN {c} >= 20 THEN '十' ELSE '' END || CASE WHEN {c} % 10 > 0 THEN substr('〇一二三四五六七八九', {c} % 10 + 1, 1) ELSE '' END ELSE CAST({c} AS STRING) END"


@query("words_of_orders", f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, {_SAID} AS said, {_KIN} AS kin, o_custkey, o_orderkey, {_DATA} AS data, CAST(o_orderkey % 50 AS INT) AS n FROM orders),
d AS (SELECT *, CAST(regexp_extract(said, '年(\\d+)月', 1) AS INT) AS m, TRY_CAST(regexp_extract(said, '月(\\d+)日', 1) AS INT) AS dd FROM o)
SELECT id, {_IN_WORDS('n')} AS number, CASE WHEN contains(said, 'X') THEN said ELSE translate(substr(said, 1, 4), '0123456789', '〇一二三四五六七八九') || '年' || {_IN_WORDS('m')} || '月' || {_IN_WORDS('dd')} || '日' END AS date,
 CASE WHEN kin IS NULL OR kin = '患者本人' THEN '' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '系死者甲之' ELSE '系患者' END || CASE o_custkey % 5 WHEN 1 THEN '之子' WHEN 2 THEN '母亲' ELSE '配偶' END END AS kinship,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'defendants' ELSE 'case_type' END AS missing FROM d""")
def words_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS id", f"{_SAID} AS said", f"{_KIN} AS kin", f"{_DATA} AS data", "CAST(o_orderkey % 50 AS INT) AS n", "o_orderkey % 2 = 0 AS died")
    c = F.col
    return rows.select("id", wording.number_in_words(c("n")).alias("number"), wording.date_in_words(c("said")).alias("date"), wording.kinship(c("kin"), c("died"), F.lit("甲")).alias("kinship"), wording.first_missing(c("data")).alias("missing"))


SEVERAL = """
import json, re
from datetime import date, timedelta


def generate(data):
    first = date(2024, 1, 1) + timedelta(days=data["n"] % 40)
    for k in range(data["n"] % 4):
        if k == 2 and data["n"] % 8 == 3:
            raise ValueError("no third")
        yield f"{first.isoformat()} {re.sub('[^0-9]', '', data['name'])[-3:]} {json.dumps(k)}"
"""


@query("generated_parts", """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey AS n, c_name FROM customer), p AS (SELECT *, unnest(CASE WHEN n % 4 = 0 THEN [NULL] ELSE range(n % 4) END) AS part FROM c)
SELECT id, CAST(part AS INT) AS part, CASE WHEN part IS NOT NULL AND NOT (part = 2 AND n % 8 = 3) THEN CAST(CAST(DATE '2024-01-01' + CAST(n % 40 AS INT) AS DATE) AS STRING) || ' ' || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 3) || ' ' || CAST(part AS STRING) END AS document, CASE WHEN part = 2 AND n % 8 = 3 THEN 'ValueError: no third' END AS error FROM p""")
def generated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("n"))).alias("data"))
    return generators.generated_rows(rows, SEVERAL, trusted=True).drop("data")


CHANGES = (
    "CAST(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS INT) AS tenant_id", "concat('t', CAST(user_id % 11 AS STRING)) AS name", "CAST(ts AS TIMESTAMP) AS ts", "CAST(event_id AS BIGINT) AS seq",
    "CASE event_id % 9 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'delete' WHEN 3 THEN 'restore' WHEN 4 THEN 'clear' ELSE 'update' END AS action",
    "CASE WHEN event_id % 2 = 0 THEN concat('d', CAST(event_id AS STRING)) END AS description", "CASE WHEN event_id % 5 = 0 THEN concat('r', CAST(event_id AS STRING)) END AS rules", "CASE WHEN event_id % 7 = 0 THEN concat('c', CAST(event_id AS STRING)) END AS code", "CASE WHEN event_id % 3 <> 0 THEN concat('f', CAST(event_id AS STRING)) END AS reference",
)
ASKED = ("CAST(event_id AS BIGINT) AS id", "CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS INT) AS tenant_id", "concat('t', CAST(user_id % 12 AS STRING)) AS name", "CAST(ts AS TIMESTAMP) AS ts")
VERSIONS_CTE = f"""ch AS (SELECT {', '.join(CHANGES)} FROM events), cb AS (SELECT *, coalesce(max(CASE WHEN action = 'create' THEN 1 END) OVER p, 0) = 1 AS made FROM ch WINDOW p AS (PARTITION BY tenant_id, name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ct AS (SELECT *, CASE WHEN action = 'create' OR (action = 'restore' AND made) THEN true WHEN action = 'delete' THEN false END AS turn FROM cb),
cw AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY tenant_id, name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY tenant_id, name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), false) AS here FROM ct),
ck AS (SELECT * FROM cw WHERE CASE action WHEN 'create' THEN true WHEN 'restore' THEN made AND NOT was ELSE was END), cl AS (SELECT *, sum(CASE WHEN action = 'create' AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS life FROM ck),
cf AS (SELECT tenant_id, name, ts, seq, here, lead(ts) OVER (PARTITION BY tenant_id, name ORDER BY ts, seq) AS valid_to, {", ".join(f"last_value(CASE WHEN action IN ('create', 'update') THEN {f} END IGNORE NULLS) OVER l AS {f}" for f in templates.FIELDS[:3])}, last_value(CASE WHEN action = 'clear' THEN '-' WHEN action IN ('create', 'update') THEN reference END IGNORE NULLS) OVER l AS ref FROM cl WINDOW l AS (PARTITION BY tenant_id, name, life ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
versions AS (SELECT tenant_id, name, CAST(row_number() OVER (PARTITION BY tenant_id, name ORDER BY ts, seq) AS INT) AS version, ts AS valid_from, valid_to, description, rules, code, nullif(ref, '-') AS reference, valid_to IS NULL AS is_current FROM cf WHERE here)"""
_MICROS = "CAST(epoch_us({}) AS BIGINT) AS {}"


def _micros(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.unix_micros(F.col(c)) for c in columns})


@query("template_versions", f"WITH {VERSIONS_CTE} SELECT * REPLACE ({_MICROS.format('valid_from', 'valid_from')}, {_MICROS.format('valid_to', 'valid_to')}) FROM versions")
def template_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(templates.versions(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*CHANGES)), "valid_from", "valid_to")


@query("template_as_of", f"""WITH {VERSIONS_CTE}, a AS (SELECT {', '.join(ASKED)} FROM events),
m AS (SELECT a.id, v.*, row_number() OVER (PARTITION BY a.id ORDER BY v.tenant_id IS NULL, v.valid_from DESC, v.version DESC) AS k FROM a JOIN versions v ON v.name = a.name AND (v.tenant_id IS NOT DISTINCT FROM a.tenant_id OR v.tenant_id IS NULL) AND v.valid_from <= a.ts AND (v.valid_to IS NULL OR v.valid_to > a.ts))
SELECT a.id, m.tenant_id, m.version, {_MICROS.format('m.valid_from', 'valid_from')}, m.description, m.rules, m.code, m.reference FROM a LEFT JOIN m ON m.id = a.id AND m.k = 1""")
def template_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asked when for which template: the version of the tenant's own or, without one, of that for all."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _micros(templates.as_of(templates.versions(rows.selectExpr(*CHANGES)), rows.selectExpr(*ASKED)), "valid_from")


@query("empty_form", "WITH i AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, '{item}', '{words}')" for k, rows in basis.FORMS.items() for n, (item, words) in enumerate(rows)) + ") AS t(kind, place, item, basis)) SELECT CAST(o_orderkey AS BIGINT) AS case_id, CAST(place AS INT) AS place, item, basis FROM orders JOIN i ON i.kind = CASE WHEN o_orderstatus = 'F' THEN 'death' ELSE 'injury' END")
def empty_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.form(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS case_id", "CASE WHEN o_orderstatus = 'F' THEN 'death' ELSE 'injury' END AS case_type"))


_WHO = "CASE WHEN case_id % 3 = 0 THEN concat('原告', CAST(case_id AS STRING)) WHEN case_id % 3 = 1 THEN '' END"
_YEARS = "CASE WHEN victim_age >= 75 THEN 5 WHEN victim_age >= 60 THEN greatest(20 - (victim_age - 60), 5) WHEN victim_age > 0 AND compensation_years <= 0 THEN 20 ELSE compensation_years END"
_DAYS = "CASE WHEN nursing_days > 0 THEN nursing_days ELSE hospital_days END"


@query("calculation_bases", f"""WITH {PARAMS_CTE}, p AS (SELECT *, coalesce(nullif({_WHO}, ''), '原告') AS who, {_YEARS} AS y, {_DAYS} AS nd FROM params)
SELECT case_id,
 CASE WHEN nd > 0 THEN who || '共住院治疗' || nd || '天，其护理费按上一年度居民服务、修理和其他服务业非私营单位在岗职工年平均工资102000元/年计算：102000元/年÷365天×' || nd || '天' || CASE WHEN nursing_person_count > 1 THEN '× ' || nursing_person_count || '人' ELSE '' END || CASE nursing_dependency_level WHEN 'mostly' THEN '× 大部分护理依赖(80%)' WHEN 'partial' THEN '× 部分护理依赖(50%)' ELSE '' END END AS nursing_fee_basis,
 CASE WHEN lost_wage_days > 0 THEN who || '的误工费按上一年度职工月平均工资8500元/月计算：8500元/月÷30天×' || lost_wage_days || '天' END AS lost_wages_basis,
 CASE WHEN hospital_days > 0 THEN who || '共住院治疗' || hospital_days || '天，按100元/天计算：100元/天×' || hospital_days || '天' END AS food_subsidy_basis,
 CASE WHEN hospital_days > 0 THEN who || '共住院治疗' || hospital_days || '天，按30元/天计算：30元/天×' || hospital_days || '天' END AS nutrition_fee_basis,
 CASE WHEN compensation_years > 0 THEN '按上一年度城镇居民人均可支配收入49283元/年×' || compensation_years || '年×伤残系数' || CAST(CAST(disability_coefficient AS DOUBLE) AS VARCHAR) || '（含被扶养人生活费 ¥' || CAST(CAST(CAST(33382 AS DECIMAL(18,2)) * compensation_years * disability_coefficient AS DECIMAL(18,2)) AS VARCHAR) || '）' END AS disability_compensation_basis,
 CASE WHEN y > 0 THEN '按上一年度城镇居民人均可支配收入49283元/年×' || y || '年（含被扶养人生活费 ¥' || CAST(CAST(33382 * y AS DECIMAL(18,2)) AS VARCHAR) || '）' END AS death_compensation_basis,
 '按上一年度职工月平均工资8500元/月，以六个月总额计算：8500元/月×6月' AS funeral_fee_basis FROM p""")
def calculation_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = basis.bases(params(spark, sf_dir), F.expr(_WHO))
    return out.select("case_id", *[c for c in out.columns if c.endswith("_basis")])
