"""Receipts, hospital totals, compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import fees
from .derived import PARAMS_CTE, RECEIPTS_CTE, params, receipts

NAME_TYPE = """CASE WHEN regexp_matches(filename, '日常用品|护理用品|生活用品|护理品|陪护用品|医疗器械|医用器械|康复器械|辅助器具|护理器械|轮椅|拐杖|助行器|护理床|医用耗材') THEN 'nursing_supplies'
 WHEN regexp_matches(filename, '住院清单|住院费用|住院发票|住院结算') THEN 'hospital_fee' WHEN regexp_matches(filename, '门诊费用|门诊发票|门诊清单|门诊结算') THEN 'outpatient_fee'
 WHEN regexp_matches(filename, '医保结算|医保报销|医保清单') THEN 'medical_fee' WHEN regexp_matches(filename, '外购药|外购|药店') THEN 'pharmacy_fee' END"""
TEXT_TYPE = """CASE WHEN regexp_matches(ocr_text, '住院|入院') THEN 'hospital_fee' WHEN contains(ocr_text, '门诊') THEN 'outpatient_fee' WHEN contains(ocr_text, '医保') AND regexp_matches(ocr_text, '结算|报销') THEN 'medical_fee'
 WHEN regexp_matches(ocr_text, '外购|药店') THEN 'pharmacy_fee' ELSE 'medical_fee' END"""
LABEL = "CASE fee_type WHEN 'nursing_supplies' THEN '护理用品/医疗器械' WHEN 'hospital_fee' THEN '住院费用' WHEN 'outpatient_fee' THEN '门诊费用' WHEN 'pharmacy_fee' THEN '外购药品费' ELSE CASE WHEN by_name OR contains(ocr_text, '医保') THEN '医保结算' ELSE '医疗费用' END END"
AMOUNT = r"[：:\s]*[¥￥]?\s*([\d,]+\.?\d*)"
TOTAL = f"coalesce(TRY_CAST(replace(nullif(regexp_extract(ocr_text, '合\\s*计{AMOUNT}', 1), ''), ',', '') AS DECIMAL(18,2)), TRY_CAST(replace(nullif(regexp_extract(ocr_text, '总\\s*计{AMOUNT}', 1), ''), ',', '') AS DECIMAL(18,2)))"
PARSED_CTE = f"""{RECEIPTS_CTE}, typed AS (SELECT *, coalesce({NAME_TYPE}, {TEXT_TYPE}) AS fee_type, {NAME_TYPE} IS NOT NULL AS by_name, {TOTAL} AS amount FROM receipts),
parsed AS (SELECT material_id, case_id, fee_type, {LABEL} AS description, amount FROM typed WHERE amount > 0)"""
INSURANCE = f"coalesce(TRY_CAST(replace(nullif(regexp_extract(ocr_text, '统筹支付{AMOUNT}', 1), ''), ',', '') AS DECIMAL(18,2)), 0)"
DETAILS_CTE = f"""{RECEIPTS_CTE}, amounts AS (SELECT *, coalesce({TOTAL}, 0) AS total, CAST({INSURANCE} AS DECIMAL(18,2)) AS insurance FROM receipts),
details AS (SELECT material_id, case_id, coalesce(nullif(regexp_extract(ocr_text, '([^\\n，。；:：]{{2,20}}?(?:医院|卫生院|诊所|卫生所))', 1), ''), '未知医院') AS hospital,
 printf('%04d-%02d-%02d', CAST(regexp_extract(ocr_text, '(\\d{{4}})年(\\d+)月(\\d+)日', 1) AS INT), CAST(regexp_extract(ocr_text, '(\\d{{4}})年(\\d+)月(\\d+)日', 2) AS INT), CAST(regexp_extract(ocr_text, '(\\d{{4}})年(\\d+)月(\\d+)日', 3) AS INT)) AS receipt_date,
 total, insurance, greatest(total - insurance, 0) AS self_pay, CASE WHEN length(regexp_replace(filename, '[^0-9]', '', 'g')) >= 4 THEN right(regexp_replace(filename, '[^0-9]', '', 'g'), 4) ELSE '' END AS tail FROM amounts)"""


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("receipt_fee_parse", f"WITH {PARSED_CTE} SELECT material_id, case_id, fee_type, description, CAST(amount AS DOUBLE) AS amount FROM parsed")
def receipt_fee_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(fees.parsed_receipts(receipts(spark, sf_dir)), "amount")


@query("receipt_details", f"WITH {DETAILS_CTE} SELECT material_id, case_id, hospital, receipt_date, CAST(total AS DOUBLE) AS total, CAST(insurance AS DOUBLE) AS insurance, CAST(self_pay AS DOUBLE) AS self_pay, tail FROM details")
def receipt_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(fees.receipt_details(receipts(spark, sf_dir)), "total", "insurance", "self_pay")


@query("fees_by_hospital_rollup", f"WITH {DETAILS_CTE} SELECT hospital, CAST(grouping(hospital) AS INT) AS is_total, count(*) AS receipts, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(insurance) AS DOUBLE) AS insurance, CAST(sum(self_pay) AS DOUBLE) AS self_pay FROM details GROUP BY ROLLUP (hospital)")
def fees_by_hospital_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(fees.by_hospital(fees.receipt_details(receipts(spark, sf_dir))), "total", "insurance", "self_pay")


@query("fee_summary_by_type", f"""WITH {PARSED_CTE}, raw AS (SELECT case_id, CASE WHEN material_id % 13 = 0 THEN ' ' ELSE fee_type END AS fee_type, CASE WHEN material_id % 11 = 0 THEN 'n/a' WHEN material_id % 7 = 0 THEN '-5' ELSE CAST(amount AS STRING) END AS amount FROM parsed)
SELECT case_id, fee_type, CAST(round(sum(TRY_CAST(replace(amount, ',', '') AS DECIMAL(20,4))), 2) AS DOUBLE) AS amount, count(*) AS n_items FROM raw WHERE TRY_CAST(replace(amount, ',', '') AS DECIMAL(20,4)) > 0 AND trim(fee_type) <> '' GROUP BY 1, 2""")
def fee_summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fees.parsed_receipts(receipts(spark, sf_dir)).selectExpr("case_id", "CASE WHEN material_id % 13 = 0 THEN ' ' ELSE fee_type END AS fee_type", "CASE WHEN material_id % 11 = 0 THEN 'n/a' WHEN material_id % 7 = 0 THEN '-5' ELSE CAST(amount AS STRING) END AS amount")
    return _doubles(fees.fee_summary(items, ["case_id"]), "amount")


@query("category_totals_rollup", f"WITH {PARSED_CTE} SELECT fee_type, description, CAST(grouping(fee_type) + grouping(description) AS INT) AS depth, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM parsed GROUP BY ROLLUP (fee_type, description)")
def category_totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = fees.parsed_receipts(receipts(spark, sf_dir))
    return parsed.rollup("fee_type", "description").agg((F.grouping("fee_type") + F.grouping("description")).cast("int").alias("depth"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


PICK = f"""WITH {DETAILS_CTE}, r AS (SELECT case_id, material_id AS seq, total, insurance FROM details WHERE material_id % 10 % 3 = 0)
SELECT case_id, seq, CAST(total AS DOUBLE) AS total, CAST(insurance AS DOUBLE) AS insurance FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN insurance > 0 THEN 0 ELSE 1 END, CASE WHEN insurance > 0 THEN -total ELSE 0 END, seq) AS k FROM r WHERE insurance > 0 OR total <> 0) WHERE k = 1"""


@query("inpatient_pick", PICK)
def inpatient_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = fees.receipt_details(receipts(spark, sf_dir)).where("material_id % 10 % 3 = 0")
    return _doubles(fees.inpatient_pick(details.withColumnRenamed("material_id", "seq")), "total", "insurance")


@query("death_years_ladder", f"WITH {PARAMS_CTE} SELECT case_id, CAST(CASE WHEN victim_age <= 0 THEN compensation_years WHEN victim_age >= 75 THEN 5 WHEN victim_age >= 60 THEN greatest(20 - (victim_age - 60), 5) WHEN compensation_years > 0 THEN compensation_years ELSE 20 END AS INT) AS years FROM params")
def death_years_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params(spark, sf_dir).select("case_id", fees.death_years(F.col("victim_age"), F.col("compensation_years")).cast("int").alias("years"))


COMPENSATION_CTE = f"""{PARSED_CTE}, {PARAMS_CTE},
sums AS (SELECT case_id, CAST(sum(CASE WHEN fee_type = 'nursing_supplies' THEN 0 ELSE amount END) AS DECIMAL(18,2)) AS medical_total, CAST(sum(CASE WHEN fee_type = 'nursing_supplies' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS supplies_total FROM parsed GROUP BY 1),
p AS (SELECT params.*, coalesce(medical_total, 0) AS m, coalesce(supplies_total, 0) AS s, CASE WHEN nursing_days > 0 THEN nursing_days ELSE hospital_days END AS nd, CASE WHEN nutrition_days > 0 THEN nutrition_days ELSE hospital_days END AS ud,
  greatest(nursing_person_count, 1) AS np, CASE nursing_dependency_level WHEN 'mostly' THEN 8 WHEN 'partial' THEN 5 ELSE 10 END AS lv, CASE WHEN disability_coefficient <= 0 AND victim_age > 0 THEN 1 ELSE disability_coefficient END AS dc,
  CASE WHEN victim_age <= 0 THEN compensation_years WHEN victim_age >= 75 THEN 5 WHEN victim_age >= 60 THEN greatest(20 - (victim_age - 60), 5) WHEN compensation_years > 0 THEN compensation_years ELSE 20 END AS dy FROM params LEFT JOIN sums USING (case_id)),
items AS (
 SELECT case_id, 'medical_fee' AS fee_type, CAST(m AS DOUBLE) AS amount, m = 0 AS is_manual, case_type FROM p
 UNION ALL SELECT case_id, 'lost_wages', round(8500.0 * lost_wage_days / 30, 2), lost_wage_days <= 0, case_type FROM p
 UNION ALL SELECT case_id, 'nursing_fee', CAST(CAST(round(CAST(102000 * nd * np * lv AS DOUBLE) / 3650, 2) AS DECIMAL(18,2)) + s AS DOUBLE), nd = 0 AND s = 0, case_type FROM p
 UNION ALL SELECT case_id, 'food_subsidy', hospital_days * 100.0, hospital_days = 0, case_type FROM p
 UNION ALL SELECT case_id, 'nutrition_fee', ud * 30.0, ud = 0, case_type FROM p
 UNION ALL SELECT case_id, 'disability_compensation', CASE WHEN disability_coefficient > 0 AND compensation_years > 0 THEN CAST(round(CAST(49283 * compensation_years AS DECIMAL(18,2)) * disability_coefficient, 2) AS DOUBLE) ELSE 0 END, NOT (disability_coefficient > 0 AND compensation_years > 0), case_type FROM p WHERE case_type = 'injury'
 UNION ALL SELECT case_id, 'death_compensation', 49283.0 * greatest(dy, 0), dy <= 0, case_type FROM p WHERE case_type <> 'injury'
 UNION ALL SELECT case_id, 'dependent_living', CASE WHEN dc > 0 AND compensation_years > 0 THEN CAST(round(CAST(33382 * compensation_years AS DECIMAL(18,2)) * dc, 2) AS DOUBLE) ELSE 0 END, NOT (dc > 0 AND compensation_years > 0), case_type FROM p
 UNION ALL SELECT case_id, 'funeral_fee', 51000.0, false, case_type FROM p WHERE case_type <> 'injury'
 UNION ALL SELECT case_id, 'transport_fee', 0, true, case_type FROM p
 UNION ALL SELECT case_id, 'appraisal_fee', 0, true, case_type FROM p
 UNION ALL SELECT case_id, 'spiritual_damage', CASE WHEN disability_coefficient > 0 THEN CAST(round(disability_coefficient * 50000, 0) AS DOUBLE) ELSE 0 END, disability_coefficient <= 0, case_type FROM p)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = fees.parsed_receipts(receipts(spark, sf_dir))
    supplies = F.col("fee_type") == "nursing_supplies"
    zero = F.lit(0).cast("decimal(18,2)")
    sums = parsed.groupBy("case_id").agg(F.sum(F.when(supplies, zero).otherwise(F.col("amount"))).cast("decimal(18,2)").alias("medical_total"), F.sum(F.when(supplies, F.col("amount")).otherwise(zero)).cast("decimal(18,2)").alias("supplies_total"))
    return fees.compensation(params(spark, sf_dir).join(sums, "case_id", "left"))


@query("compensation_items", f"WITH {COMPENSATION_CTE} SELECT case_id, fee_type, CAST(amount AS DOUBLE) AS amount, is_manual FROM items")
def compensation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(_items(spark, sf_dir), "amount")


@query("compensation_total_override", f"""WITH {COMPENSATION_CTE}, o AS (SELECT case_id, fee_type, amount, CASE WHEN (case_id + length(fee_type)) % 5 = 0 THEN 0 WHEN (case_id + length(fee_type)) % 7 = 0 THEN 1000 END AS manual FROM items)
SELECT case_id, CAST(coalesce(sum(CASE WHEN fee_type <> 'dependent_living' THEN CAST(coalesce(nullif(manual, 0), amount) AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total, count(*) FILTER (nullif(manual, 0) IS NOT NULL) AS n_manual FROM o GROUP BY 1""")
def compensation_total_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id") + F.length("fee_type")
    manual = F.when(k % 5 == 0, 0).when(k % 7 == 0, 1000).cast("decimal(18,2)")
    return _doubles(fees.compensation_total(_items(spark, sf_dir).withColumn("manual_amount", manual)), "total")


@query("stay_days", f"WITH {RECEIPTS_CTE} SELECT material_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(ocr_text, '住院\\s*(\\d+)\\s*天', 1), '') AS INT), 0) AS INT) AS days FROM receipts")
def stay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts(spark, sf_dir).select("material_id", T.stay_days(F.col("ocr_text")).cast("int").alias("days"))


@query("stay_days_from_dates", "SELECT CAST(o_orderkey AS BIGINT) AS case_id, CAST(CASE WHEN o_orderkey % 400 BETWEEN 1 AND 365 THEN o_orderkey % 400 ELSE 0 END AS INT) AS days FROM orders")
def stay_days_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "concat('入院 ', date_format(o_orderdate, 'yyyy年M月d日'), '，出院 ', date_format(date_add(to_date(o_orderdate), CAST(o_orderkey % 400 AS INT)), 'yyyy年M月d日'))"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS case_id", f"{said} AS t").select("case_id", T.stay_days(F.col("t")).cast("int").alias("days"))


DATES = "CASE o_orderkey % 7 WHEN 0 THEN concat(y, '年', m, '月', d, '日') WHEN 1 THEN concat(y, '/', m, '/', d) WHEN 2 THEN concat(y, '-', m, '-', d) WHEN 3 THEN concat(y, '.', m, '.', d) WHEN 4 THEN concat(y, '年', m, '月') WHEN 5 THEN concat(replace(y, '0', 'O'), '年') ELSE 'unknown' END"
PARTS = ("CAST(o_orderkey AS BIGINT) AS o_orderkey", "CAST(year(o_orderdate) AS STRING) AS y", "CAST(month(o_orderdate) AS STRING) AS m", "CAST(day(o_orderdate) AS STRING) AS d")


@query("normalize_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN concat(y, '年', m, '月', d, '日') WHEN o_orderkey % 7 = 4 THEN concat(y, '年', m, '月') WHEN o_orderkey % 7 = 5 THEN concat(y, '年') ELSE 'unknown' END AS date FROM (SELECT {', '.join(PARTS)} FROM orders)")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*PARTS)
    return rows.selectExpr("o_orderkey", f"{DATES} AS t").select("o_orderkey", T.normalized_date(F.col("t")).alias("date"))
