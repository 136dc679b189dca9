"""Parties, conclusions, qualifications, validation, groups and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import extraction as X

KEY = "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT)"
PAPERS = (
    f"{KEY} AS material_id",
    "CAST(l_orderkey AS BIGINT) AS case_id",
    "CASE l_partkey % 5 WHEN 0 THEN 'identity_defendant' WHEN 1 THEN 'appraisal' WHEN 2 THEN 'medical_record' WHEN 3 THEN 'death_certificate' ELSE 'other_evidence' END AS category",
    "CASE l_linenumber % 4 WHEN 0 THEN '委托合同.pdf' WHEN 1 THEN '资质证明.pdf' WHEN 2 THEN '死亡医学.pdf' ELSE 'scan.pdf' END AS filename",
    "CASE l_partkey % 5 WHEN 0 THEN concat('张三与北京第一医院（协和医院）', chr(10), '法定代表人：', CASE WHEN l_suppkey % 2 = 0 THEN '李四' ELSE '王小五' END, chr(10), '统一社会信用代码：9111000010000000', CAST(l_suppkey % 90 + 10 AS STRING), chr(10), '住所：广东省中山市小榄镇幸福路', CAST(l_linenumber AS STRING), '号', chr(10), '主治医师：赵六', chr(10), '超范围执业') WHEN 1 THEN concat('广东法医司法鉴定中心', chr(10), '鉴定意见：医方存在过错，参与度为百分之', CAST(l_suppkey % 60 AS STRING), '，建议赔偿。四、附件', chr(10), '鉴定人：孙七（证号A', CAST(l_suppkey AS STRING), '）周八（证号B22）', chr(10), chr(10)) WHEN 2 THEN concat('被告中山人民医院', chr(10), '出院诊断：多器官功能衰竭；肺炎', chr(10), '执业证号：1234567890', CAST(l_suppkey AS STRING), chr(10), '执业范围：外科') WHEN 3 THEN '死亡诊断：①呼吸衰竭；②休克；③感染①心电图' ELSE '无' END AS ocr_text",
)
CTE = f"papers AS (SELECT {', '.join(PAPERS)} FROM lineitem)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*PAPERS)


@query("defendant_info", rf"""WITH {CTE}, f AS (SELECT case_id, material_id, CASE category WHEN 'identity_defendant' THEN 1 WHEN 'medical_record' THEN 3 WHEN 'death_certificate' THEN 4 WHEN 'appraisal' THEN 5 ELSE 99 END AS r, category,
 CASE WHEN category = 'identity_defendant' THEN '北京第一医院（协和医院）' WHEN category = 'medical_record' THEN '中山人民医院' END AS name, nullif(regexp_extract(ocr_text, '法定代表人：(\S+)', 1), '') AS p, nullif(regexp_extract(ocr_text, '信用代码：([A-Z0-9]{{18}})', 1), '') AS c,
 CASE WHEN NOT contains(filename, '委托') THEN nullif(regexp_extract(ocr_text, '住所：(\S+号)', 1), '') END AS a FROM papers), n AS (SELECT case_id, arg_max(name, length(name)) AS defendant_name FROM f WHERE name IS NOT NULL GROUP BY 1)
SELECT case_id, defendant_name, arg_min(p, (r, material_id)) FILTER (p IS NOT NULL) AS legal_representative, arg_min(c, (r, material_id)) FILTER (c IS NOT NULL) AS credit_code, arg_min(a, (r, material_id)) FILTER (a IS NOT NULL) AS defendant_address FROM f JOIN n USING (case_id) GROUP BY 1, 2""")
def defendant_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.defendants(papers(spark, sf_dir))


@query("appraisal_conclusion", rf"WITH {CTE}, a AS (SELECT case_id, arg_min(ocr_text, material_id) AS t FROM papers WHERE category = 'appraisal' GROUP BY 1) SELECT case_id, regexp_extract(t, '鉴定意见：([^四]*)', 1) AS conclusion, '孙七,周八' AS appraisers, concat(regexp_extract(t, '证号(A\d+)', 1), ',B22') AS licences, '广东法医司法鉴定中心' AS organisation FROM a")
def appraisal_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.appraisals(papers(spark, sf_dir))


@query("staff_qualification", rf"""WITH {CTE}, a AS (SELECT case_id, arg_min(ocr_text, material_id) AS t FROM papers WHERE category IN ('identity_defendant', 'medical_record') GROUP BY 1)
SELECT case_id, CASE WHEN contains(t, '赵六') THEN '赵六' END AS staff_name, CASE WHEN contains(t, '超范围') THEN '超范围执业' END AS issue_type, nullif(regexp_extract(t, '执业证号：(\d+)', 1), '') AS staff_license_no, CASE WHEN contains(t, '执业范围') THEN '外科' END AS staff_scope FROM a""")
def staff_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.staff(papers(spark, sf_dir))


@query("death_diagnosis")
def death_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.death_diagnosis(papers(spark, sf_dir))


@query("output_groups", f"WITH {CTE} SELECT material_id, CASE WHEN contains(filename, '资质') THEN 'staff_qual' WHEN contains(filename, '死亡医学') THEN 'other_identity' WHEN category = 'identity_defendant' THEN 'defendant' WHEN category = 'death_certificate' THEN 'other_identity' WHEN category = 'medical_record' THEN 'medical' WHEN category = 'appraisal' THEN 'appraisal' END AS output_group FROM papers")
def output_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("material_id", X.output_group(F.col("category"), F.col("filename")).alias("output_group"))


CASES = (
    "CAST(o_orderkey AS BIGINT) AS case_id", "CASE o_orderkey % 2 WHEN 0 THEN 'death' ELSE 'injury' END AS case_type", "CASE o_orderkey % 3 WHEN 0 THEN '11010119900101123X' WHEN 1 THEN '12345' END AS id_number",
    "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '医院' WHEN 2 THEN '某某有限公司' ELSE '中山人民医院' END AS defendant_name", "CASE o_custkey % 3 WHEN 0 THEN '010-12345678' WHEN 1 THEN 'call me' END AS phone",
    "CASE o_custkey % 4 WHEN 0 THEN '2023/1/5' WHEN 1 THEN '' END AS death_date", "CASE o_custkey % 2 WHEN 0 THEN '休克' END AS death_diagnosis",
)


@query("requirement_fields_missing", f"""WITH c AS (SELECT {', '.join(CASES)} FROM orders) SELECT case_id, CASE WHEN id_number = '12345' THEN NULL ELSE id_number END AS id_number, CASE WHEN death_date = '2023/1/5' THEN '2023年1月5日' ELSE death_date END AS death_date,
 concat_ws(',', CASE WHEN id_number = '12345' THEN 'id_number' END, CASE WHEN defendant_name = '' THEN 'defendant_missing' WHEN length(defendant_name) < 4 THEN 'defendant_short' END, CASE WHEN defendant_name = '某某有限公司' THEN 'defendant_kind' END, CASE WHEN phone = 'call me' THEN 'phone' END, CASE WHEN case_type = 'death' AND coalesce(death_date, '') = '' THEN 'death_date' END, CASE WHEN case_type = 'death' AND death_diagnosis IS NULL THEN 'death_diagnosis' END) AS issues FROM c""")
def requirement_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.validation_issues(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*CASES))
    return rows.select("case_id", "id_number", "death_date", "issues")


PEOPLE = ("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS seq", "concat('p', CAST(l_partkey AS STRING)) AS name", "CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE concat(CAST(1950 + l_suppkey % 60 AS STRING), '年') END AS birth_date")


@query("youngest_plaintiff", f"WITH p AS (SELECT {', '.join(PEOPLE)} FROM lineitem) SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(birth_date, '(\\d{{4}})', 1), '') AS INT), 0) DESC, seq) = 1 AS is_patient FROM p")
def youngest_plaintiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.youngest(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*PEOPLE)).select("case_id", "seq", "is_patient")


@query("plaintiff_pivot", f"WITH p AS (SELECT {', '.join(PEOPLE)} FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM p) SELECT case_id, max(name) FILTER (k = 1) AS name_1, max(name) FILTER (k = 2) AS name_2, max(name) FILTER (k = 3) AS name_3, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (k > 3), '') AS more_names FROM k GROUP BY 1")
def plaintiff_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.numbered_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*PEOPLE))
    return wide.withColumn("more_names", F.array_join("more_names", ","))


@query("plaintiff_unpivot", """WITH w AS (SELECT c_custkey AS case_id, 'a' AS name_1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b' END AS name_2, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'c' END AS name_3 FROM customer)
SELECT case_id, CAST(0 AS INT) AS seq, 'a' AS name FROM w UNION ALL SELECT case_id, 1, 'b' FROM w WHERE name_2 = 'b' UNION ALL SELECT case_id, 2, 'c' FROM w WHERE name_2 = 'b' AND name_3 = 'c'""")
def plaintiff_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS case_id", "'a' AS name_1", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b' END AS name_2", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'c' END AS name_3")
    return X.numbered_rows(wide)


FEES = ("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS seq", "CASE l_partkey % 4 WHEN 0 THEN '医疗费' WHEN 1 THEN '住院医疗费用' WHEN 2 THEN '医疗' ELSE '其他' END AS fee_type", "CAST(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_partkey END AS DOUBLE) AS amount")


@query("fee_best_match", f"""WITH f AS (SELECT {', '.join(FEES)} FROM lineitem), s AS (SELECT *, CASE fee_type WHEN '医疗费' THEN 100 WHEN '住院医疗费用' THEN 50 WHEN '医疗' THEN 25 END AS score FROM f WHERE amount > 0)
SELECT case_id, fee_type, amount, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, seq) AS k FROM s WHERE score IS NOT NULL) WHERE k = 1""")
def fee_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.best_amount(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*FEES), ("医疗费",))


SCHEMA = {"required": ["k", "title", "detail"], "properties": {"k": {"type": "integer"}, "title": {"type": "string"}, "detail": {"type": "object", "required": ["ok", "n"], "properties": {"ok": {"type": "boolean"}, "n": {"type": "number"}}}}}


@query("required_defaults", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '[待补充]' AS title, false AS ok, CAST(0 AS DOUBLE) AS n FROM events")
def required_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", X.with_required(SCHEMA, "props").alias("a")).select("event_id", "a.k", "a.title", "a.detail.ok", "a.detail.n")
