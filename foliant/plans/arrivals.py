"""Files, recognition answers and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import ingest as I
from ..sources import watch
from ..streaming import events as E
from ..streaming import limiter
from .derived import BLOCKS_CTE, blocks

FILES = ("CAST(o_orderkey AS BIGINT) AS id", "(o_orderkey % 23 <> 0) AS exists", "CASE WHEN o_orderkey % 19 = 0 THEN 'a.docx' ELSE 'a.PDF' END AS name", "CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN 600000000 ELSE o_custkey * 1000 + 1 END AS BIGINT) AS length", "(o_orderkey % 11 <> 0) AS readable", "(o_orderkey % 7 = 0) AS encrypted", "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey * 2 END AS INT) AS pages")


@query("file_validation", f"""WITH f AS (SELECT {', '.join(FILES)} FROM orders), c AS (SELECT *, CASE WHEN NOT exists THEN 'FILE_NOT_FOUND' WHEN NOT ends_with(lower(name), '.pdf') THEN 'INVALID_EXTENSION' WHEN length = 0 THEN 'EMPTY_FILE' WHEN length > 524288000 THEN 'FILE_TOO_LARGE' WHEN NOT readable THEN 'PDF_CORRUPTED' WHEN encrypted THEN 'PDF_ENCRYPTED' WHEN pages = 0 THEN 'EMPTY_PDF' WHEN pages > 2000 THEN 'TOO_MANY_PAGES' END AS error_code FROM f)
SELECT id, error_code, error_code IS NULL AS is_valid, CASE WHEN error_code IS NULL AND pages > 100 THEN 'MANY_PAGES' ELSE '' END AS warnings FROM c""")
def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.validated(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*FILES))
    return rows.select("id", "error_code", "is_valid", F.concat_ws(",", "warnings").alias("warnings"))


PAGES = ("doc_id", "CAST(page AS INT) AS page", "CAST((doc_id * 37 + page * 91) % 700 AS INT) AS chars")
PAGES_CTE = f"""r AS (SELECT doc_id, unnest(generate_series(0, doc_id % 14)) AS page FROM documents), p AS (SELECT {', '.join(PAGES)} FROM r)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "explode(sequence(0, CAST(doc_id % 14 AS INT))) AS page").selectExpr(*PAGES)


@query("text_pdf_sampling", f"""WITH {PAGES_CTE}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p), s AS (SELECT * FROM n WHERE page < 3 OR page >= n - 3 OR page BETWEEN n // 2 - 1 AND n // 2 + 1), g AS (SELECT doc_id, count(*) AS sampled, round(avg(CAST(chars >= 300 AS INT)), 4) AS text_ratio FROM s GROUP BY 1)
SELECT doc_id, sampled, text_ratio, CASE WHEN text_ratio >= 0.8 THEN 'text' WHEN text_ratio >= 0.2 THEN 'mixed' ELSE 'scan' END AS kind FROM g""")
def text_pdf_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.text_kind(_pages(spark, sf_dir))


@query("text_pdf_head", f"WITH {PAGES_CTE} SELECT doc_id, min(chars) >= 300 AS is_text FROM p WHERE page < 3 GROUP BY 1")
def text_pdf_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.text_at_ingest(_pages(spark, sf_dir))


@query("selected_pages", f"WITH {PAGES_CTE} SELECT doc_id, page + 1 AS page FROM p WHERE doc_id % 3 = 0 OR page + 1 IN (1, 3, 5)")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("doc_id", (F.col("page") + 1).alias("page"))
    chosen = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 <> 0").selectExpr("doc_id", "array(5, 1, 3, 3, 99) AS selected")
    return I.selected_pages(pages, chosen)


@query("font_histogram", f"WITH {BLOCKS_CTE}, c AS (SELECT doc_id, font, count(*) AS n FROM blocks GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font) AS INT) AS place FROM c) SELECT * FROM r WHERE place <= 2")
def font_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.font_histogram(blocks(spark, sf_dir), 2)


@query("heading_candidates", f"WITH {BLOCKS_CTE}, m AS (SELECT *, max(font) OVER (PARTITION BY doc_id) AS m FROM blocks) SELECT doc_id, idx FROM m WHERE font >= m * 0.8 OR bold")
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.heading_candidates(blocks(spark, sf_dir)).select("doc_id", "idx")


@query("file_stability", "WITH l AS (SELECT user_id AS path, event_id AS seen_at, CAST(CAST(floor(value) AS INT) % 3 * 10 AS INT) AS length FROM events), b AS (SELECT *, lag(length) OVER (PARTITION BY path ORDER BY seen_at) AS p FROM l) SELECT path, min(seen_at) AS stable_at, arg_min(length, seen_at) AS length FROM b WHERE length = p AND length > 0 GROUP BY 1")
def file_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stable(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS path", "event_id AS seen_at", "CAST(CAST(floor(value) AS INT) % 3 * 10 AS INT) AS length"))


ANSWER = """CASE doc_id % 4 WHEN 0 THEN concat('[{"text": "a', CAST(doc_id AS STRING), '", "confidence": 0.5}, {"text": " "}, {"text": "b"}]') WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), '[{"text": "c"}]', chr(10), '```') WHEN 2 THEN 'The result is [{"text": "d", "confidence": 0.75}] as asked' ELSE concat('plain', chr(10), '', chr(10), 'line ', CAST(doc_id AS STRING)) END"""


@query("answer_parse", """SELECT doc_id, CAST(idx AS INT) AS idx, text, CAST(conf AS DOUBLE) AS conf FROM (
 SELECT doc_id, 0 AS idx, concat('a', CAST(doc_id AS STRING)) AS text, 0.5 AS conf FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 2, 'b', 0.95 FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 0, 'c', 0.95 FROM documents WHERE doc_id % 4 = 1
 UNION ALL SELECT doc_id, 0, 'd', 0.75 FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 0, 'plain', 0.90 FROM documents WHERE doc_id % 4 = 3 UNION ALL SELECT doc_id, 2, concat('line ', CAST(doc_id AS STRING)), 0.90 FROM documents WHERE doc_id % 4 = 3)""")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.parsed_answers(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{ANSWER} AS answer"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.unix_seconds("start"))


@query("progress_latest", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS status, CAST(greatest(0, least(100, arg_max(CAST(floor(value * 3) AS INT) - 20, event_id))) AS INT) AS progress, count(*) AS messages FROM events GROUP BY 1")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("user_id AS task_id", "event_type AS status", "CAST(floor(value * 3) AS INT) - 20 AS progress", "event_id AS seq")
    return E.latest(rows)


@query("event_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _start(E.tumbling(events(spark, sf_dir), "1 hour", "event_type"))


@query("event_sliding", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) - 3600 * k AS BIGINT) AS start, event_type, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) AS v(k) GROUP BY 1, 2")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _start(E.sliding(events(spark, sf_dir), "2 hours", "1 hour", "event_type"))


@query("event_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM r GROUP BY user_id, k""")
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _start(E.sessions(events(spark, sf_dir), "6 hours", "user_id"))


@query("rate_limit_windows", "SELECT CAST(user_id % 3 AS INT) AS model, CAST(epoch(time_bucket(INTERVAL 60 SECONDS, ts)) AS BIGINT) AS start, count(*) AS refusals, CAST(CASE WHEN count(*) >= 5 THEN 4 ELSE 8 END AS INT) AS permits FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'").withColumn("model", (F.col("user_id") % 3).cast("int"))
    return _start(E.rate_limits(rows))


CHANGES = ("CAST(user_id AS STRING) AS key", "CAST(event_id AS BIGINT) AS seq", "CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS BIGINT) AS change")


@query("admission_running_count", f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM (SELECT {', '.join(CHANGES)} FROM events)),
r AS (SELECT key, seq, change, k, CAST(greatest(change, 0) AS BIGINT) AS used, change > 0 AS admitted FROM c WHERE k = 1
 UNION ALL SELECT c.key, c.seq, c.change, c.k, CASE WHEN c.change < 0 THEN greatest(r.used - 1, 0) WHEN r.used < 3 THEN r.used + 1 ELSE r.used END, c.change > 0 AND r.used < 3 FROM r JOIN c ON c.key = r.key AND c.k = r.k + 1)
SELECT key, seq, change, used, admitted FROM r""")
def admission_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.admissions(events(spark, sf_dir).selectExpr(*CHANGES), 3)


@query("first_arrivals", "SELECT event_type AS tenant_id, md5(CAST(user_id AS STRING)) AS md5, min(event_id) AS path FROM events GROUP BY 1, 2")
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("event_type AS tenant_id", "md5(CAST(user_id AS STRING)) AS md5", "event_id AS path", "ts")
    return E.fresh_files(rows).select("tenant_id", "md5", "path")


LIMITED = ("CASE user_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text' ELSE 'other' END AS model", "CAST(event_id AS BIGINT) AS seq", "concat('r', CAST(user_id % 40 AS STRING)) AS request", "CASE event_type WHEN 'click' THEN 'release' WHEN 'error' THEN 'refusal' ELSE 'acquire' END AS action", "timestamp_millis(CAST(unix_micros(ts) / 1000000 AS BIGINT)) AS ts", "CAST(CAST(value AS INT) % 9 AS DOUBLE) AS wait_s")


@query("permit_answers")
def permit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken a thousand times as fast as requests for permits, held against a simulation of every millisecond in tests."""
    return limiter.answers(events(spark, sf_dir).selectExpr(*LIMITED))


LISTINGS = "SELECT concat('scan', CAST(user_id % 97 AS STRING), '.pdf') AS path, CAST(floor(event_id / 200) AS BIGINT) AS n, CAST(max(CAST(floor(value) AS INT) % 2) * 10 AS BIGINT) AS length FROM events GROUP BY 1, 2"


@query("folder_arrivals", f"""WITH l AS ({LISTINGS}), i AS (SELECT *, n - row_number() OVER (PARTITION BY path ORDER BY n) AS island FROM l),
w AS (SELECT *, min(n) OVER (PARTITION BY path, island) AS appeared, lag(length, 1) OVER o AS one, lag(length, 2) OVER o AS two FROM i WINDOW o AS (PARTITION BY path, island ORDER BY n))
SELECT path, appeared, min(n) AS taken_at, arg_min(length, n) AS length FROM w WHERE length > 0 AND length = one AND length = two GROUP BY 1, 2""")
def folder_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of a folder: files that settled, once for each time that they appeared."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return watch.appearances(spark.sql(LISTINGS))
