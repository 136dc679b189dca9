"""Results of several recognition engines, brought together page by page and line by line.

Rows are lines: doc_id, page, engine, priority, idx, text, conf (hundredths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_amount_line, stripped

# Confidences in hundredths.
FLOOR, NUMERIC, RETRY, CLOUD_TOP, CLOUD_LOW, LAST_RESORT = 70, 85, 50, 85, 50, 30
PAGE = ("doc_id", "page")


def floored(lines: DataFrame, least: int = FLOOR) -> DataFrame:
    """Lines that are not blank and reach the floor."""
    return lines.where((F.col("conf") >= least) & (stripped(F.col("text")) != ""))


def by_priority(lines: DataFrame) -> DataFrame:
    """Of each page, the lines of the first engine that has any."""
    first = lines.groupBy(*PAGE).agg(F.min("priority").alias("_p"))
    return lines.join(first, list(PAGE)).where(F.col("priority") == F.col("_p")).drop("_p")


def batch_engine(lines: DataFrame) -> DataFrame:
    """Per document, the first engine that read anything on any page, its pages and lines."""
    per = lines.groupBy("doc_id", "engine", "priority").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("lines"))
    return per.groupBy("doc_id").agg(F.min_by(F.struct("engine", "pages", "lines"), "priority").alias("b")).select("doc_id", "b.*")


def cloud_refined(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Pages with the source that is kept: cloud where the local mean is middling and the cloud's is higher."""
    mean = lambda d, n: d.groupBy(*PAGE).agg((F.sum("conf") / F.count("*")).alias(n))
    both = mean(local, "local_conf").join(mean(cloud, "cloud_conf"), list(PAGE), "left")
    middling = (F.col("local_conf") >= CLOUD_LOW) & (F.col("local_conf") < CLOUD_TOP)
    better = middling & F.coalesce(F.col("cloud_conf") > F.col("local_conf"), F.lit(False))
    return both.select(*PAGE, F.when(better, "cloud").otherwise("local").alias("source"), F.when(better, F.col("cloud_conf")).otherwise(F.col("local_conf")).alias("confidence"))


def last_resort(pages: DataFrame, limit: int = 3) -> DataFrame:
    """Pages (case_id, page, confidence) with fallback: the first few of a case that are hardly read at all."""
    low = F.col("confidence") < LAST_RESORT
    w = Window.partitionBy("case_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("fallback", low & (F.sum(low.cast("int")).over(w) <= limit))


def tiered(lines: DataFrame) -> DataFrame:
    """lines with tier: keep, retry or drop; amounts need more confidence than words."""
    need = F.when(is_amount_line(F.col("text")), NUMERIC).otherwise(FLOOR)
    return lines.withColumn("tier", F.when(F.col("conf") >= need, "keep").when(F.col("conf") >= RETRY, "retry").otherwise("drop"))


def retried(lines: DataFrame, other: DataFrame) -> DataFrame:
    """Kept lines, and middling ones with the confidence of the same text by another engine (its last line of that text) if higher."""
    again = other.where(stripped(F.col("text")) != "").groupBy("doc_id", "page", stripped(F.col("text")).alias("_t")).agg(F.max_by("conf", "idx").alias("_c"))
    rows = tiered(lines).where("tier <> 'drop'").withColumn("_t", stripped(F.col("text")))
    joined = rows.join(again, [*PAGE, "_t"], "left")
    better = (F.col("tier") == "retry") & (F.col("_c") > F.col("conf"))
    return joined.select(*PAGE, "idx", "text", F.when(better, F.col("_c")).otherwise(F.col("conf")).alias("conf"), F.coalesce(better, F.lit(False)).alias("improved"))


def region_retry(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Middling lines (40 to 70) with a region's reading of the same line if it is surer and overlaps: one text
    contains the other, or they share more than half of the line's different characters."""
    a, b = stripped(F.col("text")), stripped(F.col("r_text"))
    chars = lambda t: F.array_distinct(F.split(t, ""))
    overlap = F.contains(b, a) | F.contains(a, b) | (F.size(F.array_intersect(chars(a), chars(b))) > F.length(a) * 0.5)
    r = regions.select(*PAGE, "idx", F.col("text").alias("r_text"), F.col("conf").alias("r_conf"))
    joined = lines.where((F.col("conf") >= 40) & (F.col("conf") < 70)).join(r, [*PAGE, "idx"], "left")
    take = F.coalesce((F.col("r_conf") > F.col("conf")) & overlap, F.lit(False))
    return joined.select(*PAGE, "idx", F.when(take, F.col("r_text")).otherwise(F.col("text")).alias("text"), F.when(take, F.col("r_conf")).otherwise(F.col("conf")).alias("conf"), take.alias("improved"))


def cache_hits(pages: DataFrame, cache: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Per engine, how many pages (engine, digest) are in the cache and fresh, and how many are not."""
    fresh = cache.where(F.col("stored_at") >= F.expr(f"timestamp '{now}' - INTERVAL {hours} HOURS")).select("engine", "digest").distinct().withColumn("_hit", F.lit(True))
    return pages.join(fresh, ["engine", "digest"], "left").groupBy("engine").agg(F.count_if("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
