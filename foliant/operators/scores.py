"""The score of a document from its blocks, in one plan: sections, paragraphs, lists, tables and pages share one exchange by document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from . import structure as S

SENTENCE_ENDS = "。！？.!?"
LEVELS = 5


@F.arrow_udf(StructType([StructField("lists", IntegerType()), StructField("items", IntegerType())]))
def list_sizes(lines: pa.Array) -> pa.Array:
    """Lists of two items or more, and their items, of a document's lines in order (type, x, ends): the rules of structure.lists()."""
    sizes = []
    for document in lines.to_pylist():
        found, now = [], None
        base = sum(r["x"] for r in document) / max(1, len(document))
        for r in document:
            if r["type"] is not None:
                shift = r["x"] - base
                indent = 0 if shift < 20 else min(int(shift / 40), 3)
                if now and now[0] == r["type"] and abs(indent - now[1]) <= 1:
                    now[2], now[3] = now[2] + 1, r["x"]
                    continue
                found += [now] if now else []
                now = [r["type"], indent, 1, r["x"]]
            elif not (now and not r["ends"] and r["x"] >= now[3] - 10):
                found += [now] if now else []
                now = None
        kept = [x[2] for x in found + ([now] if now else []) if x[2] >= 2]
        sizes.append({"lists": len(kept), "items": sum(kept)})
    return pa.array(sizes, pa.struct([("lists", pa.int32()), ("items", pa.int32())]))


def _with_ancestors(rows: DataFrame, by_idx: Window) -> DataFrame:
    """rows with parent, parent_level and depth of headings, from the last heading of each level before."""
    before = by_idx.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_p{k}": F.max(F.when(F.col("heading") & (F.col("level") == k), F.col("idx"))).over(before) for k in range(1, LEVELS)})
    rows = rows.withColumns({"parent": F.lit(None).cast("int"), "parent_level": F.lit(None).cast("int"), "depth": F.lit(1)})
    for k in range(1, LEVELS):
        nearer = (F.col("level") > k) & F.col(f"_p{k}").isNotNull() & (F.col(f"_p{k}") > F.coalesce("parent", F.lit(-1)))
        rows = rows.withColumns({"parent": F.when(nearer, F.col(f"_p{k}")).otherwise(F.col("parent")), "parent_level": F.when(nearer, k).otherwise(F.col("parent_level")), "depth": F.col("depth") + F.coalesce(nearer.cast("int"), F.lit(0))})
    return rows.drop(*[f"_p{k}" for k in range(1, LEVELS)])


def counts(blocks: DataFrame, gap: int = 80, spread: float = 1.5, table_share: float = 0.25) -> DataFrame:
    """What structure.quality() scores, of each document, from blocks (doc_id, page from 0, idx, text, conf in hundredths, x, y, h).

    Pages without a block up to the last one are empty pages. A region dense in symbols is a table, and
    filled if it has two lines or more. Lines of a document meet in one place, so documents are of bounded length.
    """
    by_idx = Window.partitionBy("doc_id").orderBy("idx")
    page = Window.partitionBy("doc_id", "page")
    reading = [F.col("y"), F.col("x"), F.col("idx")]
    # stripped once, and all that the text decides is settled before the exchange, so that no text is shuffled or sorted
    text = F.col("_t")
    bare = blocks.withColumn("_t", T.stripped(F.col("text")))
    ends = (text == "") | F.substring(text, -1, 1).isin(*SENTENCE_ENDS)
    rows = bare.select(
        "doc_id", "page", "idx", "conf", "x", "y", "h", (text != "").alias("full"), ends.alias("ends"), T.heading_pattern_level(text, bare=True).alias("level"), T.list_type(text).alias("type"),
        T.dense_in_symbols(F.col("text")).alias("dense"), T.is_page_number(text, bare=True).alias("number"),
    )
    line = F.col("full") & ~F.col("number")
    rows = rows.withColumns({"heading": F.coalesce(line & F.col("level").isNotNull(), F.lit(False)), "body": F.coalesce(line & F.col("level").isNull(), F.lit(False))})
    rows = _with_ancestors(rows, by_idx).withColumn("section", F.max(F.when(F.col("heading"), F.col("idx"))).over(by_idx))

    sibling = F.lag("level").over(Window.partitionBy("doc_id", "heading", "parent").orderBy("idx"))
    rows = rows.withColumn("_above", F.coalesce(sibling, "parent_level", F.lit(0)))
    paragraph = Window.partitionBy("doc_id", "body", "section", "page").orderBy(*reading).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("y") + F.col("h")).over(paragraph)
    rows = rows.withColumn("_starts", F.col("body") & (reached.isNull() | (F.col("y") - reached > gap)))
    rows = S.islands(rows.withColumn("_h", F.avg("h").over(page)), ["doc_id", "page"], reading, F.col("y"), F.col("y") + F.col("h"), F.col("_h") * spread, "region")
    region = Window.partitionBy("doc_id", "page", "region")
    rows = rows.withColumns({"_lines": F.count("*").over(region), "_dense": F.count_if("dense").over(region), "_first": F.min("idx").over(region) == F.col("idx"), "_mean": F.round(F.avg("conf").over(page) / 100, 4), "_opens": F.min("idx").over(page) == F.col("idx")})

    table = F.col("_first") & (F.col("_dense") / F.col("_lines") >= table_share)
    opening = lambda c: F.count_if(F.col("_opens") & c)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("idx", "type", F.col("x").cast("double").alias("x"), "ends"))), lambda r: F.struct(r["type"].alias("type"), r["x"].alias("x"), r["ends"].alias("ends")))
    pages: Column = F.max("page") + 1
    out = rows.groupBy("doc_id").agg(
        F.round(F.avg("conf") / 100, 4).alias("confidence"), pages.alias("pages"), opening(F.col("_mean") < 0.6).alias("_low"), (pages - opening(F.lit(True))).alias("empty_pages"),
        F.coalesce(F.stddev_samp(F.when(F.col("_opens") & (F.col("_mean") > 0), F.col("_mean"))), F.lit(0.0)).alias("deviation"), opening((F.col("_mean") > 0) & (F.col("_mean") < 0.3)).alias("very_low_pages"),
        F.count_if("heading").alias("sections"), F.coalesce(F.max(F.when(F.col("heading"), F.col("depth"))), F.lit(0)).alias("depth"), F.count_if("_starts").alias("paragraphs"), F.count_if(F.col("_starts") & F.col("section").isNull()).alias("orphans"),
        F.count_if(F.col("heading") & (F.col("_above") > 0) & (F.col("level") > F.col("_above") + 1)).alias("skips"), F.size(F.collect_set(F.when(F.col("heading"), F.col("level")))).alias("levels"),
        F.count_if(table).alias("tables"), F.count_if(table & (F.col("_lines") >= 2)).alias("filled_tables"), lines.alias("lines"),
    )
    out = out.withColumn("_l", list_sizes("lines")).withColumn("low_pages", F.col("_low") + F.col("empty_pages"))
    names = ("doc_id", "confidence", "pages", "low_pages", "empty_pages", "deviation", "very_low_pages", "sections", "depth", "paragraphs", "orphans", "skips")
    return out.select(*names, F.col("sections").alias("headings"), "levels", F.col("_l.lists").alias("lists"), F.col("_l.items").alias("list_items"), "tables", "filled_tables")
