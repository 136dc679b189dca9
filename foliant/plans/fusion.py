"""Several engines' readings brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import fusion as O
from .derived import BLOCKS_CTE, blocks

ENGINES = (
    "doc_id", "page", "idx", "engine", "priority",
    "CASE WHEN engine = 'cloud' AND idx % 5 = 0 THEN concat(text, '!') ELSE text END AS text",
    "CAST(CASE engine WHEN 'local' THEN conf WHEN 'cloud' THEN 25 + (conf * 7 + idx) % 74 ELSE 20 + (conf * 3) % 60 END AS INT) AS conf",
)
KEPT = "NOT ((engine = 'local' AND page % 4 = 1) OR (engine = 'cloud' AND page % 3 = 2))"
AMOUNTS = "CASE WHEN idx % 3 = 0 THEN concat(CAST(conf AS STRING), '.00') WHEN idx % 3 = 1 THEN concat(line, ' 元') ELSE line END AS text"
LINES_CTE = f"{BLOCKS_CTE}, base AS (SELECT doc_id, page, idx, conf, {AMOUNTS} FROM blocks), eng(engine, priority) AS (VALUES ('local', 1), ('cloud', 2), ('vision', 3)), lines_ AS (SELECT {', '.join(ENGINES)} FROM base CROSS JOIN eng), el AS (SELECT * FROM lines_ WHERE {KEPT})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = blocks(spark, sf_dir).selectExpr("doc_id", "page", "idx", "conf", AMOUNTS)
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(p).alias("priority")) for e, p in (("local", 1), ("cloud", 2), ("vision", 3))]))
    return base.withColumn("_e", engines).select("*", "_e.*").selectExpr(*ENGINES).where(KEPT)


@query("confidence_floor", f"WITH {LINES_CTE} SELECT doc_id, idx, engine, conf FROM el WHERE conf >= 70 AND trim(text) <> ''")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.floored(lines(spark, sf_dir)).select("doc_id", "idx", "engine", "conf")


@query("engine_fallback_pick", f"WITH {LINES_CTE}, f AS (SELECT doc_id, page, min(priority) AS p FROM el GROUP BY 1, 2) SELECT el.doc_id, el.page, el.idx, engine, text, conf FROM el JOIN f ON f.doc_id = el.doc_id AND f.page = el.page AND f.p = el.priority")
def engine_fallback_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.by_priority(lines(spark, sf_dir)).select("doc_id", "page", "idx", "engine", "text", "conf")


@query("batch_fallback", f"WITH {LINES_CTE}, g AS (SELECT doc_id, engine, priority, count(DISTINCT page) AS pages, count(*) AS lines FROM el GROUP BY 1, 2, 3) SELECT doc_id, arg_min(engine, priority) AS engine, arg_min(pages, priority) AS pages, arg_min(lines, priority) AS lines FROM g GROUP BY 1")
def batch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batch_engine(lines(spark, sf_dir))


@query("engine_usage", f"WITH {LINES_CTE} SELECT engine, count(*) AS n, count(DISTINCT doc_id) AS documents FROM el GROUP BY 1")
def engine_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("cloud_refine", f"""WITH {LINES_CTE}, l AS (SELECT doc_id, page, sum(conf) / count(*) AS a FROM el WHERE engine = 'local' GROUP BY 1, 2), c AS (SELECT doc_id, page, sum(conf) / count(*) AS b FROM el WHERE engine = 'cloud' GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN a >= 50 AND a < 85 AND b > a THEN 'cloud' ELSE 'local' END AS source, CASE WHEN a >= 50 AND a < 85 AND b > a THEN b ELSE a END AS confidence FROM l LEFT JOIN c USING (doc_id, page)""")
def cloud_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return O.cloud_refined(rows.where("engine = 'local'"), rows.where("engine = 'cloud'"))


@query("fallback_cap3", f"""WITH {BLOCKS_CTE}, p AS (SELECT doc_id AS case_id, page, min(conf) - 10.0 AS confidence FROM blocks GROUP BY 1, 2) SELECT case_id, page, CAST(confidence AS DOUBLE) AS confidence, confidence < 30 AND sum(CAST(confidence < 30 AS INT)) OVER (PARTITION BY case_id ORDER BY page ROWS UNBOUNDED PRECEDING) <= 3 AS fallback FROM p""")
def fallback_cap3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks(spark, sf_dir).groupBy(F.col("doc_id").alias("case_id"), "page").agg((F.min("conf") - F.lit(10.0)).alias("confidence"))
    return O.last_resort(pages)


AMOUNT_LINE = rf"(regexp_matches(trim(text), '{T.NUMBERS_ONLY}') OR regexp_matches(text, '元|万|￥|¥|\$|合计|总计|金额'))"
TIER = f"CASE WHEN conf >= CASE WHEN {AMOUNT_LINE} THEN 85 ELSE 70 END THEN 'keep' WHEN conf >= 50 THEN 'retry' ELSE 'drop' END"


@query("numeric_line_tiering", f"WITH {LINES_CTE} SELECT doc_id, idx, engine, {TIER} AS tier FROM el")
def numeric_line_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tiered(lines(spark, sf_dir)).select("doc_id", "idx", "engine", "tier")


@query("retry_map_merge", f"""WITH {LINES_CTE}, l AS (SELECT *, {TIER} AS tier FROM el WHERE engine = 'local'), o AS (SELECT doc_id, page, trim(text) AS t, arg_max(conf, idx) AS c FROM el WHERE engine = 'cloud' AND trim(text) <> '' GROUP BY 1, 2, 3)
SELECT l.doc_id, l.page, idx, text, CASE WHEN tier = 'retry' AND c > conf THEN c ELSE conf END AS conf, coalesce(tier = 'retry' AND c > conf, false) AS improved FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.page = l.page AND o.t = trim(l.text) WHERE tier <> 'drop'""")
def retry_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return O.retried(rows.where("engine = 'local'"), rows.where("engine = 'cloud'"))


@query("region_retry_overlap", f"""WITH {LINES_CTE}, l AS (SELECT * FROM el WHERE engine = 'local' AND conf >= 40 AND conf < 70), r AS (SELECT doc_id, page, idx, text AS rt, conf AS rc FROM el WHERE engine = 'cloud'),
j AS (SELECT l.*, rt, rc, coalesce(rc > conf AND (contains(trim(rt), trim(text)) OR contains(trim(text), trim(rt)) OR len(list_intersect(list_distinct(string_split(trim(text), '')), list_distinct(string_split(trim(rt), '')))) > length(trim(text)) * 0.5), false) AS take FROM l LEFT JOIN r USING (doc_id, page, idx))
SELECT doc_id, page, idx, CASE WHEN take THEN rt ELSE text END AS text, CASE WHEN take THEN rc ELSE conf END AS conf, take AS improved FROM j""")
def region_retry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return O.region_retry(rows.where("engine = 'local'"), rows.where("engine = 'cloud'"))


@query("result_cache_hits", f"""WITH {BLOCKS_CTE}, p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS engine, md5(concat(CAST(doc_id AS STRING), '/', CAST(page AS STRING))) AS digest, doc_id, page FROM (SELECT DISTINCT doc_id, page FROM blocks)),
c AS (SELECT DISTINCT engine, digest FROM p WHERE doc_id % 3 = 0 AND TIMESTAMP '2024-01-02 00:00:00' - to_hours(CAST(doc_id % 48 AS INT)) >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOURS) SELECT p.engine, count(*) FILTER (c.digest IS NOT NULL) AS hits, count(*) FILTER (c.digest IS NULL) AS misses FROM p LEFT JOIN c USING (engine, digest) GROUP BY 1""")
def result_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks(spark, sf_dir).select("doc_id", "page").distinct().selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS engine", "md5(concat(CAST(doc_id AS STRING), '/', CAST(page AS STRING))) AS digest", "doc_id")
    cache = pages.where("doc_id % 3 = 0").selectExpr("engine", "digest", "timestampadd(HOUR, -CAST(doc_id % 48 AS INT), timestamp '2024-01-02 00:00:00') AS stored_at")
    return O.cache_hits(pages, cache, "2024-01-02 00:00:00")
