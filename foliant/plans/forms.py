"""Rule fields, receipts by labels, manual edits and generated paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import casework as C
from ..operators import fees

KEY = "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT)"
PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
BASE_STRIP = r"regexp_replace({}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"

NOTES = (
    f"{KEY} AS material_id",
    f"concat(CASE l_partkey % 4 WHEN 0 THEN '近亲属：王小明，' WHEN 1 THEN '监护人 李四五。' ELSE '' END, CASE l_suppkey % 3 WHEN 0 THEN concat('主诉：反复咳嗽伴发热', CAST(l_linenumber AS STRING), '天余。') WHEN 1 THEN '因车祸致左下肢疼痛三小时入院。' ELSE '症状轻' END, '检查费：', {PRICE}, ' 床位费 1,234.50', chr(10), '护理费:¥3.4.5 手术费¥', CAST(l_linenumber AS STRING), chr(10), CASE l_linenumber % 3 WHEN 0 THEN '合计：' WHEN 1 THEN '费用合计 ¥' ELSE '小结' END, {PRICE}) AS ocr_text",
)
NOTES_CTE = f"notes AS (SELECT {', '.join(NOTES)} FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@query("rule_line_items", f"""WITH {NOTES_CTE}, m AS (SELECT material_id, regexp_extract_all(ocr_text, '([\\x{{4e00}}-\\x{{9fff}}]+费)[：:\\s]*[¥￥]?([\\d,.]+)', 1) AS t, regexp_extract_all(ocr_text, '([\\x{{4e00}}-\\x{{9fff}}]+费)[：:\\s]*[¥￥]?([\\d,.]+)', 2) AS n FROM notes),
u AS (SELECT material_id, unnest(range(len(t))) AS k, t, n FROM m)
SELECT material_id, CAST(k AS INT) AS place, t[k + 1] AS fee_type, TRY_CAST(replace(n[k + 1], ',', '') AS DOUBLE) AS amount FROM u WHERE TRY_CAST(replace(n[k + 1], ',', '') AS DOUBLE) IS NOT NULL""")
def rule_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_items(_lines(spark, sf_dir).selectExpr(*NOTES))


@query("rule_relations", f"""WITH {NOTES_CTE} SELECT material_id, trim(nullif(regexp_extract(ocr_text, '(法定代理人|监护人|亲属|近亲属)[：:\\s]*([^\\n，。]{{2,10}})', 2), '')) AS legal_representative, nullif(regexp_extract(ocr_text, '(法定代理人|监护人|亲属|近亲属)[：:\\s]*([^\\n，。]{{2,10}})', 1), '') AS relationship,
 trim(nullif(regexp_extract(ocr_text, '(主诉|症状|因)[：:\\s]*([^\\n。]{{10,200}})', 2), '')) AS symptoms, coalesce(TRY_CAST(replace(nullif(regexp_extract(ocr_text, '(合计|总计|金额|费用合计)[：:\\s]*[¥￥]?([\\d,.]+)', 2), ''), ',', '') AS DOUBLE), 0) AS total_amount FROM notes""")
def rule_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).selectExpr(*NOTES)
    return rows.select("material_id", C.relations(F.col("ocr_text")).alias("r")).select("material_id", "r.*")


SETTLED = (
    f"{KEY} AS material_id",
    f"concat(CASE l_partkey % 3 WHEN 0 THEN concat('医疗保障结算单', chr(10), {PRICE}, chr(10), '医疗费总额', chr(10)) WHEN 1 THEN '门诊收费票据' ELSE concat('医疗费总额', chr(10), '  1,000.5') END, chr(10), CASE l_suppkey % 4 WHEN 0 THEN concat('合计金额：', CAST(l_linenumber * 10 AS STRING), '元') WHEN 1 THEN concat('合计', chr(10), '77.10') WHEN 2 THEN '全自费金额: 12' ELSE '无' END, chr(10), CASE l_linenumber % 3 WHEN 0 THEN '统筹支付：5.25' WHEN 1 THEN concat('基金支付总额', chr(10), '3') ELSE '' END, chr(10), CASE l_linenumber % 4 WHEN 0 THEN '现金：2' WHEN 1 THEN concat('9.5', chr(10), '个人负担金额') WHEN 2 THEN '个人现金支出：1.5' ELSE '' END) AS t",
)


def _labelled(labels: tuple[str, ...]) -> str:
    number = r"([\d,]+\.\d+|[\d,]+)"
    forms = [f for x in labels for f in (rf"{x}[：:]\s*{number}", rf"{x}\s*\n\s*{number}", rf"{number}\s*\n\s*{x}")]
    found = ", ".join(f"nullif(regexp_extract(t, '{f}', 1), '')" for f in forms)
    return f"coalesce(TRY_CAST(replace(coalesce({found}), ',', '') AS DOUBLE), 0)"


@query("fee_label_amounts", f"""WITH s AS (SELECT {', '.join(SETTLED)} FROM lineitem), a AS (SELECT material_id, t, {_labelled(fees.SUM_LABELS)} AS plain, {_labelled(fees.WHOLE_LABELS)} AS whole, {_labelled(fees.OWN_WHOLE_LABELS)} AS own_whole, {_labelled(fees.INSURANCE_LABELS)} AS insurance, coalesce({', '.join(f'nullif({_labelled(x)}, 0)' for x in fees.OWN_LABELS)}, 0) AS own FROM s),
b AS (SELECT *, CASE WHEN whole > 0 AND (regexp_matches(left(t, 200), '结算单|医疗保障') OR plain <= 0) THEN whole WHEN plain > 0 THEN plain ELSE own_whole END AS amount FROM a)
SELECT material_id, amount, insurance, CASE WHEN amount > 0 AND insurance > 0 AND own = 0 THEN round(amount - insurance, 2) ELSE own END AS self_pay FROM b""")
def fee_label_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).selectExpr(*SETTLED)
    return fees.receipt_amounts(rows).drop("t")


TYPED = (
    f"{KEY} AS material_id", "CASE l_partkey % 3 WHEN 0 THEN '```json 甲医院' WHEN 1 THEN '[1]' ELSE '乙医院' END AS hospital", "concat('票', chr(10), chr(10), CAST(l_linenumber AS STRING)) AS title", "concat('f', CAST(l_partkey * 37 AS STRING), '.jpg') AS filename", "'2024年1月2日' AS date",
    f"CASE l_linenumber % 3 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE {PRICE} END AS total", "CASE l_suppkey % 2 WHEN 0 THEN '1,5' END AS insurance", "'2' AS own",
    "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2024-02-30' ELSE '2024-02-10 08:00' END AS admission", "CASE l_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-01' ELSE '2024-02-15' END AS discharge",
)


@query("fee_items_typed", f"""WITH t AS (SELECT {', '.join(TYPED)}, l_quantity AS q FROM lineitem), s AS (SELECT *, coalesce(admission, '') <> '' AND coalesce(discharge, '') <> '' AS stay, date_diff('day', TRY_CAST(left(admission, 10) AS DATE), TRY_CAST(left(discharge, 10) AS DATE)) AS d, regexp_replace(filename, '[^0-9]', '', 'g') AS digits FROM t)
SELECT material_id, CASE hospital WHEN '[1]' THEN '' WHEN '乙医院' THEN hospital ELSE '甲医院' END AS hospital, replace(title, chr(10) || chr(10), chr(10)) AS title, CASE WHEN stay THEN left(admission, 10) || ' ~ ' || left(discharge, 10) ELSE date END AS date,
 CASE WHEN coalesce(TRY_CAST(total AS DOUBLE), 0) > 0 THEN CAST(total AS DOUBLE) ELSE q + 1.5 END AS total, CASE WHEN insurance IS NULL THEN 0.0 ELSE 15.0 END AS insurance, CAST(2 AS DOUBLE) AS own, CASE WHEN stay THEN '住院' ELSE '门诊' END AS kind, CAST(CASE WHEN stay AND d >= 0 THEN d END AS INT) AS days, CASE WHEN length(digits) >= 4 THEN right(digits, 4) ELSE '' END AS tail FROM s""")
def fee_items_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = "array(CAST(l_quantity AS STRING), 'n/a', '-3', NULL, '1.5') AS amounts"
    return fees.typed_items(_lines(spark, sf_dir).selectExpr(*TYPED, amounts))


ENTRIES = ("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS material_id", "concat('c', CAST(l_suppkey % 3 AS STRING)) AS category", "concat('t', CAST(l_partkey AS STRING)) AS title", "CAST(NULL AS STRING) AS description", "'p' AS purpose", "CAST(l_linenumber AS INT) AS catalog_index")
EDITS = ("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS material_id", "k AS seq", "CASE WHEN l_suppkey % 4 = k THEN concat('m', CAST(k AS STRING)) END AS category", "CASE WHEN k = 0 THEN 'new' END AS title", "CASE WHEN l_partkey % 2 = 0 THEN concat('d', CAST(k AS STRING)) END AS description", "CAST(NULL AS STRING) AS purpose", "CASE WHEN l_partkey % 5 = 0 THEN CAST(100 + k AS INT) END AS catalog_index")


@query("catalog_edits", f"""WITH e AS (SELECT {', '.join(ENTRIES)} FROM lineitem), d AS (SELECT {', '.join(EDITS)} FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE l_linenumber % 2 = 0),
l AS (SELECT case_id, material_id, arg_max(category, seq) FILTER (category IS NOT NULL) AS c, arg_max(title, seq) FILTER (title IS NOT NULL) AS t, arg_max(description, seq) FILTER (description IS NOT NULL) AS x, arg_max(catalog_index, seq) FILTER (catalog_index IS NOT NULL) AS i FROM d GROUP BY 1, 2)
SELECT case_id, material_id, coalesce(l.c, category) AS category, coalesce(l.t, title) AS title, coalesce(l.x, description) AS description, purpose, coalesce(l.i, catalog_index) AS catalog_index FROM e LEFT JOIN l USING (case_id, material_id)""")
def catalog_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    edits = lines.where("l_linenumber % 2 = 0").selectExpr("*", "explode(array(0, 1, 2)) AS k").selectExpr(*EDITS)
    return C.edited(lines.selectExpr(*ENTRIES), edits)


GENERATED = ("CAST(o_orderkey AS BIGINT) AS case_id", "concat(CASE o_orderkey % 3 WHEN 0 THEN concat('四、司法鉴定意见', chr(10), chr(10)) WHEN 1 THEN '死者' ELSE '**原告诉称：** ' END, '于[2026]入院。', CASE o_custkey % 4 WHEN 0 THEN '该机构具备法定鉴定资质。' WHEN 1 THEN '但该鉴定意见未就参与度作出明确认定。' WHEN 2 THEN '经原告与被告某医院共同委托，' ELSE '鉴于病因尚待进一步明确，恳请法院委托。' END, chr(10), chr(10), chr(10), chr(10), '结束', CAST(o_custkey AS STRING), ' ') AS t")
CLEANED = "t"
for _p, _n in T.CLEANUPS:
    CLEANED = f"regexp_replace({CLEANED}, '{_p}', '{_n}', 'g')".replace("'\\n\\n'", "chr(10) || chr(10)")


@query("paragraph_cleanup", f"SELECT case_id, {BASE_STRIP.format(CLEANED)} AS t FROM (SELECT {', '.join(GENERATED)} FROM orders)")
def paragraph_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*GENERATED)
    return rows.select("case_id", T.cleaned_paragraph(F.col("t")).alias("t"))


RESULTS = ("CAST(o_orderkey AS BIGINT) AS case_id", *[f"CASE (o_orderkey + {i}) % 7 WHEN 0 THEN '[段落生成失败: x]' WHEN 1 THEN '见（待补充）' WHEN 2 THEN '(待补充)。' WHEN 3 THEN NULL ELSE '正文' END AS paragraph_{i}" for i in range(1, 6)], "CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '[待补充]' ELSE '某医院' END AS defendant_name", "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '张[待补充]' ELSE '张三' END AS plaintiff_name", "'（待补充）' AS court_name", "CAST(o_custkey % 2 AS INT) AS n_plaintiffs")


@query("placeholder_lists", f"""WITH r AS (SELECT {', '.join(RESULTS)} FROM orders) SELECT case_id, concat_ws(',', {', '.join(f"CASE WHEN contains(paragraph_{i}, '[段落生成失败') THEN 'paragraph_{i}' END" for i in range(1, 6))}) AS failed,
 concat_ws(',', CASE WHEN contains(defendant_name, '待补充') THEN '被告医院名称' END, CASE WHEN contains(plaintiff_name, '待补充') THEN '原告姓名' END, '受理法院', {', '.join(f"CASE WHEN contains(paragraph_{i}, '待补充') THEN 'paragraph_{i} 段落' END" for i in range(1, 6))}) AS pending,
 concat_ws(',', CASE WHEN n_plaintiffs = 0 AND coalesce(plaintiff_name, '') = '' THEN '原告姓名' END, CASE WHEN defendant_name = '' THEN '被告医院名称' END) AS missing FROM r""")
def placeholder_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*RESULTS)
    return C.placeholders(rows).select("case_id", "failed", "pending", "missing")


@query("section_gating", """SELECT CAST(o_orderkey AS BIGINT) AS case_id, CASE WHEN o_orderkey % 5 = 1 THEN 'death' ELSE 'injury' END || CASE WHEN o_orderkey % 5 = 2 OR coalesce(CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) THEN '_minor' ELSE '_adult' END AS template,
 'paragraph_1,paragraph_2' || CASE WHEN o_custkey % 2 = 0 THEN ',paragraph_3' ELSE '' END || CASE WHEN o_custkey % 4 = 0 THEN ',paragraph_4' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ',paragraph_5' ELSE '' END AS sections FROM orders""")
def section_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS case_id", "CASE o_orderkey % 5 WHEN 0 THEN 'injury' WHEN 1 THEN 'death' WHEN 2 THEN 'neonatal' WHEN 3 THEN 'other' END AS case_type", "CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_minor", "o_custkey % 2 = 0 AS a", "CASE WHEN o_custkey % 4 = 0 THEN true END AS b", "o_orderkey % 3 = 0 AS c")
    return rows.select("case_id", C.template_key(F.col("case_type"), F.col("is_minor")).alias("template"), F.array_join(C.sections_shown(F.col("a"), F.col("b"), F.col("c")), ",").alias("sections"))


PARTIES = ("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS seq", "CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE concat('p', CAST(l_partkey AS STRING)) END AS name", "CASE l_partkey % 5 WHEN 0 THEN '母亲' WHEN 1 THEN '祖母' WHEN 2 THEN '父亲' WHEN 3 THEN '' END AS relationship", "CASE l_suppkey % 3 WHEN 0 THEN '女' WHEN 1 THEN '男' END AS gender", "l_linenumber = 1 AS is_patient")


@query("mother_lookup", f"""WITH p AS (SELECT {', '.join(PARTIES)} FROM lineitem), m AS (SELECT case_id, arg_min(name, seq) FILTER (contains(relationship, '母')) AS said, arg_min(name, seq) FILTER (gender = '女' AND NOT is_patient) AS woman FROM p GROUP BY 1)
SELECT case_id, coalesce(nullif(said, ''), nullif(woman, '')) AS mother_name FROM m WHERE coalesce(nullif(said, ''), nullif(woman, '')) IS NOT NULL""")
def mother_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mothers(_lines(spark, sf_dir).selectExpr(*PARTIES))


SOURCES = [("o_orderkey % 2 = 0", "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'n1' END", "CAST(NULL AS STRING)"), ("o_orderkey % 3 = 0", "'n2'", "CASE WHEN o_custkey % 2 = 0 THEN 'a2' END"), ("o_orderkey % 5 < 4", "'n3'", "'a3'")]


@query("identity_backfill", f"""WITH {', '.join(f"s{i} AS (SELECT CAST(o_orderkey AS BIGINT) AS case_id, {n} AS name, {a} AS address FROM orders WHERE {w})" for i, (w, n, a) in enumerate(SOURCES))}, k AS (SELECT case_id FROM s0 UNION SELECT case_id FROM s1 UNION SELECT case_id FROM s2)
SELECT k.case_id, coalesce(nullif(s0.name, ''), s1.name, s2.name) AS name, coalesce(s0.address, s1.address, s2.address) AS address FROM k LEFT JOIN s0 USING (case_id) LEFT JOIN s1 USING (case_id) LEFT JOIN s2 USING (case_id)""")
def identity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return C.backfilled([orders.where(w).selectExpr("CAST(o_orderkey AS BIGINT) AS case_id", f"{n} AS name", f"{a} AS address") for w, n, a in SOURCES], "case_id", ["name", "address"])


WRITTEN_DATES = "CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), '日') WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月') WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING), '年') ELSE '不详' END"


@query("dates_sorted", f"""WITH d AS (SELECT CAST(o_custkey AS BIGINT) AS case_id, CAST(o_orderkey AS BIGINT) AS seq, {WRITTEN_DATES} AS t, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('month', CAST(o_orderdate AS DATE)) WHEN 2 THEN date_trunc('year', CAST(o_orderdate AS DATE)) END AS d FROM orders)
SELECT case_id, seq, t, CAST(row_number() OVER (PARTITION BY case_id ORDER BY d ASC NULLS LAST, seq) AS INT) AS place, {' || '.join(f"CASE substr(CAST(year(d) AS STRING), {i}, 1) " + ' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in enumerate('〇一二三四五六七八九')) + ' END' for i in range(1, 5))} AS year FROM d""")
def dates_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_custkey AS BIGINT) AS case_id", "CAST(o_orderkey AS BIGINT) AS seq", f"{WRITTEN_DATES} AS t")
    return C.by_date(rows, "case_id", "t", "seq").withColumn("year", T.chinese_year(F.year(T.parsed_date(F.col("t"))).cast("string")))


SCRAPS = ("CAST(c_custkey AS BIGINT) AS c_custkey", "CASE c_custkey % 6 WHEN 0 THEN concat('```json', chr(10), '{\"a\": 1}', chr(10), '```') WHEN 1 THEN ' [1, 2] ' WHEN 2 THEN concat('文', chr(10), chr(10), chr(10), '字```') WHEN 3 THEN concat('此', 'x', chr(7), '致') WHEN 4 THEN '此致' ELSE '第三章 总则' END AS t", "CASE c_custkey % 5 WHEN 0 THEN '1,234.5' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL WHEN 3 THEN ' 7 ' ELSE '-2' END AS n", "CASE c_custkey % 4 WHEN 0 THEN '汉' WHEN 1 THEN '满族' WHEN 2 THEN '' ELSE ' 土家 ' END AS e")


@query("scraps_cleaned", f"""WITH s AS (SELECT {', '.join(SCRAPS)} FROM customer) SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN concat('文', chr(10), '字') ELSE t END AS plain, CASE WHEN c_custkey % 6 = 3 THEN '此x致' ELSE t END AS visible,
 c_custkey % 6 >= 4 AS heading, CASE c_custkey % 5 WHEN 0 THEN 1234.5 WHEN 3 THEN 7 WHEN 4 THEN -2 ELSE 0 END AS n, CASE c_custkey % 4 WHEN 0 THEN '汉族' WHEN 1 THEN '满族' WHEN 2 THEN '' ELSE '土家族' END AS e FROM s""")
def scraps_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*SCRAPS)
    t = F.col("t")
    return rows.select("c_custkey", T.unfenced(t).alias("plain"), T.without_control_characters(t).alias("visible"), T.is_generated_heading(t).alias("heading"), T.safe_double(F.col("n")).alias("n"), T.ethnicity(F.col("e")).alias("e"))
