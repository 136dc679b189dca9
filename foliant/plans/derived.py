"""Inputs of the queries, derived from the given tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Expressions in the common dialect: no escapes in literals, casts spelled out.
RECEIPTS = (
    "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS material_id",
    "CAST(l_orderkey AS BIGINT) AS case_id",
    "CASE l_linenumber % 7 WHEN 0 THEN '护理用品清单.pdf' WHEN 1 THEN '住院费用清单.pdf' WHEN 2 THEN '门诊发票0042.jpg' WHEN 3 THEN '医保结算单.pdf' WHEN 4 THEN '外购药.pdf' WHEN 5 THEN concat('scan_', CAST(l_partkey + 1000 AS STRING), '.pdf') ELSE 'a1.pdf' END AS filename",
    "concat('第', CAST(l_suppkey % 40 AS STRING), '人民医院', chr(10), CASE l_linenumber % 3 WHEN 0 THEN '住院' WHEN 1 THEN '门诊' ELSE '医保结算' END, '发票', chr(10), '日期：', CAST(year(l_shipdate) AS STRING), '年', CAST(month(l_shipdate) AS STRING), '月', CAST(day(l_shipdate) AS STRING), '日', chr(10), CASE l_linestatus WHEN 'O' THEN '合计：¥' ELSE '总 计 ' END, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), '元', chr(10), CASE WHEN l_discount > 0.05 THEN concat('统筹支付：', CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS STRING), chr(10)) ELSE '' END, '住院', CAST(CAST(l_quantity AS INT) % 30 AS STRING), '天') AS ocr_text",
)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*RECEIPTS)


RECEIPTS_CTE = f"receipts AS (SELECT {', '.join(RECEIPTS)} FROM lineitem)"

BLOCKS = (
    "doc_id",
    "CAST(floor(idx / 10) AS INT) AS page",
    "CAST(idx AS INT) AS idx",
    "line",
    "concat(CASE (doc_id + idx) % 9 WHEN 0 THEN '第1章 ' WHEN 1 THEN '一、' WHEN 2 THEN '1. ' WHEN 3 THEN '1.1 ' WHEN 4 THEN '（一）' WHEN 5 THEN '(a) ' WHEN 6 THEN '1.1.1 ' ELSE '' END, line) AS text",
    "CAST(30 + (doc_id * 31 + idx * 17) % 70 AS INT) AS conf",
    "CAST((idx % 10) * 30 + CASE WHEN (idx % 10) >= 4 THEN 90 ELSE 0 END AS INT) AS y",
    "CAST(CASE idx % 3 WHEN 0 THEN 100 WHEN 1 THEN 104 ELSE 400 END AS INT) AS x",
    "CAST(200 AS INT) AS w",
    "CAST(20 AS INT) AS h",
    "CAST(10 + (doc_id + idx) % 4 * 2 AS INT) AS font",
    "((doc_id + idx) % 5 = 0) AS bold",
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as recognised blocks: ten to a page, with places, confidences (hundredths) and numbered prefixes."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (idx, line)")
    return lines.selectExpr(*BLOCKS)


BLOCKS_CTE = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
blocks AS (SELECT {', '.join(BLOCKS)} FROM lines)"""

PARAMS = (
    "CAST(o_orderkey AS BIGINT) AS case_id",
    "CASE o_orderstatus WHEN 'O' THEN 'injury' WHEN 'F' THEN 'death' ELSE 'injury' END AS case_type",
    "CAST(49283 AS DECIMAL(18,2)) AS annual_income",
    "CAST(33382 AS DECIMAL(18,2)) AS annual_consumption",
    "CAST(8500 AS DECIMAL(18,2)) AS monthly_salary",
    "CAST(102000 AS DECIMAL(18,2)) AS nursing_annual_salary",
    "CAST(100 AS DECIMAL(18,2)) AS daily_food_subsidy",
    "CAST(30 AS DECIMAL(18,2)) AS daily_nutrition",
    "CAST(o_orderkey % 21 AS INT) AS compensation_years",
    "CAST((o_orderkey % 11) / 10.0 AS DECIMAL(5,4)) AS disability_coefficient",
    "CAST(o_custkey % 40 AS INT) AS hospital_days",
    "CAST(o_orderkey % 91 AS INT) AS lost_wage_days",
    "CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 END AS INT) AS nursing_days",
    "CAST(CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 15 END AS INT) AS nutrition_days",
    "CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'mostly' WHEN 2 THEN 'partial' END AS nursing_dependency_level",
    "CAST(o_orderkey % 4 AS INT) AS nursing_person_count",
    "CAST(o_custkey % 100 AS INT) AS victim_age",
)


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*PARAMS)


PARAMS_CTE = f"params AS (SELECT {', '.join(PARAMS)} FROM orders)"
