"""Page structure from recognised blocks: regions, paragraphs, sections, tables, repeated lines, quality.

Blocks have doc_id, page, idx (order in the document), text, conf (hundredths), x, y, w, h. Everything
runs by document or page in windows that share one exchange; only greedy rules that depend on what
they did before fold in Python, a document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_WIDTH, PAGE_HEIGHT = 2480, 3508
PAGE = ("doc_id", "page")


def islands(rows: DataFrame, part: list[str], order: list[Column], top: Column, bottom: Column, most: Column, name: str) -> DataFrame:
    """rows with name, the number of the run that each belongs to: a run ends where top lies more than most below everything before."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(before.isNull() | (top - before > most), 1).otherwise(0)
    return rows.withColumn("_start", start).withColumn(name, F.sum("_start").over(w).cast("int")).drop("_start")


def paragraphs(blocks: DataFrame, gap: int = 80) -> DataFrame:
    """Paragraphs of each page: lines in reading order, no more than gap apart; page numbers left out.

    doc_id, page, para, n_lines, text (lines joined by spaces) and confidence (mean, hundredths).
    """
    lines = blocks.where(~T.is_page_number(F.col("text"))).withColumn("text", T.stripped(F.col("text")))
    runs = islands(lines, list(PAGE), [F.col("y"), F.col("x"), F.col("idx")], F.col("y"), F.col("y") + F.col("h"), F.lit(gap), "para")
    grouped = runs.groupBy(*PAGE, "para").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("y", "x", "idx", "text"))).alias("lines"), F.avg("conf").alias("confidence"))
    return grouped.select(*PAGE, "para", "n_lines", F.array_join("lines.text", " ").alias("text"), "confidence")


def regions(blocks: DataFrame, spread: float = 1.5, table_share: float = 0.25) -> DataFrame:
    """Regions of each page: lines no more than spread mean line heights apart, as table or text by the share of dense lines."""
    mean = F.avg("h").over(Window.partitionBy(*PAGE))
    rows = islands(blocks.withColumn("mean_h", mean), list(PAGE), [F.col("y"), F.col("x"), F.col("idx")], F.col("y"), F.col("y") + F.col("h"), F.col("mean_h") * spread, "region")
    sums = rows.groupBy(*PAGE, "region").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.count("*").alias("n_lines"), F.avg("conf").alias("confidence"), F.count_if(T.dense_in_symbols(F.col("text"))).alias("n_dense"), F.first("mean_h").alias("mean_h"),
    )
    return sums.withColumn("kind", F.when(F.col("n_dense") / F.col("n_lines") >= table_share, "table").otherwise("text"))


def with_images(found: DataFrame, page_height: int = PAGE_HEIGHT) -> DataFrame:
    """Regions of a page with an image region in each large gap between two of them, in reading order from 0."""
    w = Window.partitionBy(*PAGE).orderBy("region")
    gap = F.lead("top").over(w) - F.col("bottom")
    gaps = found.withColumn("gap", gap).where((F.col("gap") > 4 * F.col("mean_h")) & (F.col("gap") < page_height * 0.5))
    images = gaps.select(*PAGE, F.lit("image").alias("kind"), F.lit(int(PAGE_WIDTH * 0.05)).alias("left"), (F.col("bottom") + F.floor(F.col("gap") * 0.1)).cast("int").alias("top"), F.floor(F.least(F.col("gap").cast("double"), F.lit(page_height * 0.4)) * 0.8).cast("int").alias("height"))
    texts = found.select(*PAGE, "kind", F.col("left").cast("int").alias("left"), F.col("top").cast("int").alias("top"), (F.col("bottom") - F.col("top")).cast("int").alias("height"))
    order = Window.partitionBy(*PAGE).orderBy("top", "left", "kind")
    return texts.unionByName(images).withColumn("reading_order", (F.row_number().over(order) - 1).cast("int"))


def column_count(found: DataFrame, page_width: int = PAGE_WIDTH) -> DataFrame:
    """Columns of each page, 1 to 3, by gaps between the centres of its regions that are large for the page."""
    centres = found.select(*PAGE, ((F.col("left") + F.col("right")) / 2).alias("c"))
    gaps = centres.withColumn("g", F.lead("c").over(Window.partitionBy(*PAGE).orderBy("c")) - F.col("c"))
    large = F.count_if((F.col("g") > F.col("mean") * 2.5) & (F.col("g") > page_width * 0.08))
    return gaps.withColumn("mean", F.avg("g").over(Window.partitionBy(*PAGE))).groupBy(*PAGE).agg(F.when(F.count("*") < 3, 1).otherwise(F.least(large + 1, F.lit(3))).cast("int").alias("columns"))


def clusters(values: DataFrame, part: list[str], value: str, apart: Column, name: str = "centre") -> DataFrame:
    """Centres of runs of distinct values no more than apart from each other, one row a run (numbered from 0)."""
    w = Window.partitionBy(*part).orderBy(value)
    distinct = values.select(*part, value, apart.alias("_apart")).distinct()
    start = F.when(F.col(value) - F.lag(value).over(w) <= F.col("_apart"), 0).otherwise(1)
    runs = distinct.withColumn("_s", start).withColumn("_r", F.sum("_s").over(w))
    centres = runs.groupBy(*part, "_r").agg(F.avg(value).alias(name))
    return centres.select(*part, (F.col("_r") - 1).cast("int").alias("number"), name)


def nearest(items: DataFrame, centres: DataFrame, part: list[str], value: str, key: list[str]) -> DataFrame:
    """items with number, that of the nearest centre of their part; the first in a tie."""
    both = items.join(centres, part)
    best = both.groupBy(*part, *key).agg(F.min_by("number", F.struct(F.abs(F.col(value) - F.col("centre")), F.col("number"))).alias("number"))
    return items.join(best, [*part, *key])


def table_cells(items: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text) of items (doc_id, page, idx, text, x, y, w, h) of a table region with two items or more.

    Rows are runs of vertical centres 1.2 mean heights apart; columns are runs of horizontal centres, of
    each row 0.8 and over all rows 1.2 mean heights apart. Items of a cell are joined by spaces from the top.
    """
    w = Window.partitionBy(*PAGE)
    base = items.withColumn("_h", F.avg("h").over(w)).withColumn("_n", F.count("*").over(w)).where("_n >= 2")
    base = base.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    rows = clusters(base, list(PAGE), "cy", F.col("_h") * 1.2)
    placed = nearest(base, rows, list(PAGE), "cy", ["idx"]).withColumnRenamed("number", "row")
    by_row = clusters(placed, [*PAGE, "row"], "cx", F.col("_h") * 0.8, "c")
    heights = base.groupBy(*PAGE).agg(F.first("_h").alias("_h"))
    cols = clusters(by_row.join(heights, list(PAGE)), list(PAGE), "c", F.col("_h") * 1.2)
    celled = nearest(placed, cols, list(PAGE), "cx", ["idx"]).withColumnRenamed("number", "col")
    grouped = celled.groupBy(*PAGE, "row", "col").agg(F.sort_array(F.collect_list(F.struct("y", "idx", "text"))).alias("t"))
    return grouped.select(*PAGE, "row", "col", F.array_join("t.text", " ").alias("text"))


def section_of(blocks: DataFrame) -> DataFrame:
    """blocks (with level, null for body text) with section: the idx of the heading at or above; null before the first."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return blocks.withColumn("section", F.last(F.when(F.col("level").isNotNull(), F.col("idx")), ignorenulls=True).over(w))


def section_tree(headings: DataFrame) -> DataFrame:
    """doc_id, idx, level, parent, parent_level and depth of headings: the parent is the last heading before with a smaller level.

    All follow from the last heading of each level before, in one window: going down from level 1, an
    ancestor is one that comes after all those of smaller levels.
    """
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("idx"))).over(w).alias(f"_p{k}") for k in range(1, 5)]
    rows = headings.select("doc_id", "idx", "level", *above)
    parent, parent_level, depth = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in range(1, 5):
        here = F.col(f"_p{k}")
        ancestor = (F.col("level") > k) & here.isNotNull() & (here > F.coalesce(parent, F.lit(-1)))
        parent, parent_level = F.when(ancestor, here).otherwise(parent), F.when(ancestor, k).otherwise(parent_level)
        depth = depth + F.coalesce(ancestor.cast("int"), F.lit(0))
        rows = rows.select("*", parent.alias(f"_a{k}"), parent_level.alias(f"_l{k}"), depth.alias(f"_d{k}"))
        parent, parent_level, depth = F.col(f"_a{k}"), F.col(f"_l{k}"), F.col(f"_d{k}")
    return rows.select("doc_id", "idx", "level", parent.alias("parent"), parent_level.alias("parent_level"), depth.alias("depth"))


def level_skips(tree: DataFrame) -> DataFrame:
    """doc_id and the number of headings more than one level below the sibling before them, or below their parent; tree as section_tree gives it."""
    w = Window.partitionBy("doc_id", "parent").orderBy("idx")
    rows = tree.withColumn("_before", F.coalesce(F.lag("level").over(w), "parent_level", F.lit(0)))
    return rows.groupBy("doc_id").agg(F.count_if((F.col("_before") > 0) & (F.col("level") > F.col("_before") + 1)).alias("skips"), F.count("*").alias("headings"), F.countDistinct("level").alias("levels"))


def in_header(y: Column, page_height: int = PAGE_HEIGHT) -> Column:
    return (y / page_height < 0.05) | (y < 80)


def in_footer(y: Column, page_height: int = PAGE_HEIGHT) -> Column:
    return (y / page_height > 0.92) | (y > page_height - 120)


def without_repeated_lines(blocks: DataFrame, page_height: int = PAGE_HEIGHT) -> DataFrame:
    """blocks without headers and footers that come on max(2, 30 %) of a document's pages or oftener, and without page numbers there.

    Texts are compared exactly. A document under three pages or without a repeated line stays as it is.
    """
    t = T.stripped(F.col("text"))
    zone = F.when(in_header(F.col("y"), page_height), "header").when(in_footer(F.col("y"), page_height), "footer")
    rows = blocks.withColumn("_zone", F.when(t != "", zone)).withColumn("_t", t)
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    counted = rows.where("_zone is not null").groupBy("doc_id", "_zone", "_t").agg(F.count("*").alias("_c")).join(pages, "doc_id")
    repeated = counted.where((F.col("_pages") >= 3) & (F.col("_c") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * 0.3)))).select("doc_id", "_zone", "_t", F.lit(True).alias("_repeated"))
    touched = repeated.select("doc_id", F.lit(True).alias("_touched")).distinct()
    joined = rows.join(repeated, ["doc_id", "_zone", "_t"], "left").join(touched, "doc_id", "left")
    gone = F.coalesce("_repeated", F.lit(False)) | (F.coalesce("_touched", F.lit(False)) & F.col("_zone").isNotNull() & T.is_page_number(F.col("_t")))
    return joined.where(~gone).select(*blocks.columns)


@lru_cache(maxsize=64)
def _places(text: str) -> dict[str, int]:
    """Where each character of a text stands, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def longest_common(a: str, b: str) -> int:
    """Characters of the longest common subsequence: a bit of each place of a, all of them carried on at once for each character of b."""
    places, left = _places(a), (1 << len(a)) - 1
    for c in b:
        if here := places.get(c):
            met = left & here
            left = (left + met) | (left - met)
    return len(a) - (left & ((1 << len(a)) - 1)).bit_count()


def similarity_of(a: str, b: str, least: float = 0.0) -> float:
    """1 for equal texts, 0 if one is less than half as long or the longest common subsequence is too short for least, else the ratio of
    matching blocks. Those blocks follow each other in both texts, so they are never more than that subsequence has, which costs a small part of them."""
    from difflib import SequenceMatcher

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) / max(len(a), len(b)) > 0.5:
        return 0.0
    if least > 0 and 2.0 * longest_common(a, b) / (len(a) + len(b)) < least:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def similarity(left: pd.Series, right: pd.Series, least: float = 0.0) -> pd.Series:
    """similarity_of the texts of two columns."""
    return pd.Series([similarity_of(a, b, least) for a, b in zip(left, right)])


def character_tokens(texts: pd.Series) -> pd.Series:
    """A text's characters, each numbered by how often it stood before, as distinct integers; what comes rarely goes first."""

    def of(text: str) -> list[int]:
        seen: dict[str, int] = {}
        out = []
        for c in text:
            seen[c] = k = seen.get(c, -1) + 1
            out.append(-(k << 21 | ord(c)))
        return sorted(out)

    return texts.map(of)


def fuzzy_repeats(lines: DataFrame, least: float = 0.7, small: int = 500) -> DataFrame:
    """Pairs of lines of a document in one zone whose similarity is least or more: doc_id, zone, a, b, ratio.

    Up to small lines of a document's zone meet each other. Of more, lines meet by a rare character that
    both have (a ratio of least asks for so many common characters that the first tokens of both lines
    share one) and by the power of two of their length, as none is less than half as long as the other.
    The ratio is computed where the lengths and the longest common subsequence allow it.
    """
    bounded = F.pandas_udf(lambda a, b: similarity(a, b, least), "double")
    tokens = F.pandas_udf(character_tokens, "array<bigint>")
    distinct = lines.select("doc_id", "zone", "text").where("text <> ''").distinct().withColumn("n", F.length("text"))
    rows = distinct.withColumn("k", F.count("*").over(Window.partitionBy("doc_id", "zone")))
    few = rows.where(F.col("k") <= small)
    n = F.col("n")
    many = rows.where(F.col("k") > small).withColumn("p", F.slice(tokens("text"), 1, n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1)).withColumn("band", F.length(F.bin("n")))

    def side(df: DataFrame, name: str, *more: Column) -> DataFrame:
        return df.select("doc_id", "zone", F.col("text").alias(name), F.col("n").alias(f"{name}n"), *more)

    near = (F.col("a") < F.col("b")) & (2.0 * F.least("an", "bn") / (F.col("an") + F.col("bn")) >= least)
    met = side(few, "a").join(side(few, "b"), ["doc_id", "zone"]).where(near).select("doc_id", "zone", "a", "b")
    a = side(many, "a", F.col("p").alias("ap"), F.explode("p").alias("key"), F.col("band")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    b = side(many, "b", F.col("p").alias("bp"), F.explode("p").alias("key"), F.col("band"))
    once = F.array_min(F.array_intersect("ap", "bp")) == F.col("key")
    met = met.unionByName(a.join(b, ["doc_id", "zone", "band", "key"]).where(near & once).select("doc_id", "zone", "a", "b"))
    return met.withColumn("ratio", bounded("a", "b")).where(F.col("ratio") >= least)


def page_confidence(blocks: DataFrame) -> DataFrame:
    """Mean confidence and items of each page (hundredths, four places)."""
    return blocks.groupBy(*PAGE).agg(F.count("*").alias("items"), F.round(F.sum("conf") / F.count("*"), 4).alias("confidence"))


def document_confidence(blocks: DataFrame) -> DataFrame:
    """Mean over all items of a document (not of page means), pages, deviation of page means, and low pages."""
    pages = page_confidence(blocks)
    totals = blocks.groupBy("doc_id").agg(F.round(F.sum("conf") / F.count("*"), 4).alias("confidence"))
    spread = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.coalesce(F.round(F.stddev_samp("confidence"), 4), F.lit(0.0)).alias("deviation"), F.count_if(F.col("confidence") < 60).alias("low_pages"))
    return totals.join(spread, "doc_id")


def quality(documents: DataFrame, *kept: str) -> DataFrame:
    """Scores of documents from their counts, each and in total, four places, and warnings; kept: counts that stay.

    documents: doc_id, confidence (0 to 1), pages, low_pages, empty_pages, deviation, very_low_pages,
    sections, depth, paragraphs, orphans, skips, headings, levels, lists, list_items, tables, filled_tables.
    """
    c = F.col
    ocr = F.greatest(F.lit(0.0), F.least(c("confidence"), F.lit(1.0)) - F.when(c("pages") > 0, c("low_pages") / c("pages") * 0.2).otherwise(0.0))
    sections = F.when(c("sections") > 0, 0.4 + F.when(c("depth") >= 3, 0.3).when(c("depth") >= 2, 0.2).otherwise(0.1)).otherwise(0.0)
    structure = sections + F.when(c("paragraphs") > 0, 0.2).otherwise(0.0) + F.when(c("paragraphs") >= 5, 0.1).otherwise(0.0)
    orphan = c("orphans") / F.greatest(c("paragraphs"), F.lit(1))
    structure = F.least(F.lit(1.0), structure * F.when(orphan < 0.2, 1.0).when(orphan < 0.5, 0.8).otherwise(0.6))
    heading = F.when(c("sections") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 - 0.05 * c("skips") - F.when((c("levels") < 2) & (c("headings") > 5), 0.1).otherwise(0.0)))).otherwise(0.0)
    data = F.least(F.lit(1.0), 0.5 + F.when(c("lists") > 0, 0.15 + F.when(c("list_items") / c("lists") >= 3, 0.1).otherwise(0.0)).otherwise(0.0) + F.when(c("tables") > 0, 0.15 + F.when(c("filled_tables") > 0, 0.1).otherwise(0.0)).otherwise(0.0))
    empty = F.when(c("empty_pages") / F.greatest(c("pages"), F.lit(1)) > 0.3, 0.3).otherwise(0.1 * c("empty_pages"))
    strange = F.greatest(F.lit(0.0), 1.0 - empty - F.when(c("deviation") > 0.2, 0.1).otherwise(0.0) - F.when(c("very_low_pages") > 0, 0.1).otherwise(0.0) - F.when((c("sections") == 0) & (c("paragraphs") == 0), 0.3).otherwise(0.0))
    scored = documents.select("doc_id", *kept, *[F.round(x, 4).alias(n) for n, x in (("ocr", ocr), ("structure", structure), ("heading", heading), ("data", data), ("anomaly", strange))])
    weighted = [c(n).cast("decimal(6,4)") * F.lit(w).cast("decimal(3,2)") for n, w in (("ocr", "0.35"), ("structure", "0.25"), ("heading", "0.20"), ("data", "0.10"), ("anomaly", "0.10"))]
    total = sum(weighted[1:], weighted[0])
    warnings = F.array_compact(F.array(F.when(total < 0.5, "low_overall_quality"), F.when(c("ocr") < 0.5, "poor_ocr_quality"), F.when(c("structure") < 0.3, "insufficient_structure")))
    return scored.select("*", F.round(total, 4).cast("double").alias("total"), F.concat_ws(",", warnings).alias("warnings"))


def cross_page(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, idx, next_idx): a page's last line and the next page's first, where the one runs on into the other."""
    w = Window.partitionBy("doc_id").orderBy("page")
    ends = blocks.groupBy(*PAGE).agg(F.min_by(F.struct("idx", "text"), "idx").alias("first"), F.max_by(F.struct("idx", "text"), "idx").alias("last"))
    both = ends.withColumn("next", F.lead("first").over(w)).withColumn("next_page", F.lead("page").over(w)).where("next_page = page + 1")
    runs_on = T.ends_open(F.col("last.text")) & T.continues_line(F.col("next.text"))
    return both.where(runs_on).select(*PAGE, F.col("last.idx").alias("idx"), F.col("next.idx").alias("next_idx"))


def cross_page_merged(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, idx, text, conf) after each page's last line took in the next page's first where it runs on into it.

    The first line, without white space around it, is put to the end of the last one, whose confidence is the mean of both (four
    places) and whose next_page names the page taken from; the first line itself is gone. A page that is emptied so takes nothing
    in from the page after it. Only pages that follow each other by number meet.
    """
    w = Window.partitionBy("doc_id").orderBy("page")
    ends = blocks.groupBy(*PAGE).agg(F.min_by(F.struct("idx", "text", "conf"), "idx").alias("first"), F.max_by(F.struct("idx", "text"), "idx").alias("last"), F.count("*").alias("n"))
    both = ends.withColumn("next", F.lead("first").over(w)).withColumn("next_page", F.lead("page").over(w))
    fits = F.coalesce((F.col("next_page") == F.col("page") + 1) & T.ends_open(F.col("last.text")) & T.continues_line(F.col("next.text")), F.lit(False))
    rows = both.withColumn("fits", fits).withColumn("_before", F.coalesce(F.lag("fits").over(w), F.lit(False)))
    # in a run of pages of one line that all fit, every second one has been emptied by the page before
    starts = F.when(F.col("fits") & F.col("_before") & (F.col("n") == 1), 0).otherwise(1)
    runs = rows.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("page"))
    takes = runs.withColumn("takes", F.col("fits") & (place % 2 == 1)).where("takes").select(*PAGE, F.col("last.idx").alias("idx"), F.col("next").alias("_n"), "next_page")
    gone = takes.select("doc_id", F.col("_n.idx").alias("idx"), F.lit(True).alias("_gone"))
    out = blocks.join(takes.drop("page"), ["doc_id", "idx"], "left").join(gone, ["doc_id", "idx"], "left").where("_gone is null")
    merged = F.col("_n").isNotNull()
    return out.select(
        *PAGE, "idx", F.when(merged, F.concat("text", T.stripped(F.col("_n.text")))).otherwise(F.col("text")).alias("text"),
        F.when(merged, F.round((F.col("conf") + F.col("_n.conf")) / 2, 4)).otherwise(F.col("conf").cast("double")).alias("confidence"), "next_page",
    )


def document_tree(blocks: DataFrame, gap: int = 80) -> DataFrame:
    """The sections of each document, one row each: section (the heading's idx), level, title, parent, depth, its own paragraphs
    (array of their lines joined by spaces) and, for the document, sections and paragraphs in all.

    blocks: doc_id, page, idx, text, x, y, h and level (null for body text). Blank lines and page numbers are left out. Paragraphs
    before the first heading are those of a row without section. Lines of a page no more than gap apart are one paragraph.
    """
    lines = blocks.withColumn("text", T.stripped(F.col("text"))).where((F.col("text") != "") & ~T.is_page_number(F.col("text")))
    placed = section_of(lines)
    heads = section_tree(placed.where("level is not null")).join(placed.where("level is not null").select("doc_id", "idx", F.col("text").alias("title")), ["doc_id", "idx"])
    body = placed.where("level is null").withColumn("_s", F.coalesce("section", F.lit(-1)))
    runs = islands(body, ["doc_id", "_s", "page"], [F.col("y"), F.col("x"), F.col("idx")], F.col("y"), F.col("y") + F.col("h"), F.lit(gap), "para")
    paras = runs.groupBy("doc_id", "_s", "page", "para").agg(F.sort_array(F.collect_list(F.struct("y", "x", "idx", "text"))).alias("lines"))
    by_section = paras.groupBy("doc_id", "_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "para", F.array_join("lines.text", " ").alias("t")))), lambda p: p["t"]).alias("paragraphs"))
    rows = heads.withColumn("_s", F.col("idx")).join(by_section, ["doc_id", "_s"], "full_outer").withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>")))
    w = Window.partitionBy("doc_id")
    return rows.select("doc_id", F.col("idx").alias("section"), "level", "title", "parent", "depth", "paragraphs", F.count("idx").over(w).alias("sections_in_all"), F.sum(F.size("paragraphs")).over(w).alias("paragraphs_in_all"))


def with_titles(found: DataFrame, first_lines: DataFrame, page_width: int = PAGE_WIDTH) -> DataFrame:
    """Regions (with kind, left, right) whose text regions are titles where their first line (first_lines: PAGE, region, text) is short and numbered or centred."""
    text = F.col("text")
    centred = F.abs((F.col("left") + F.col("right")) / 2 - page_width / 2) < page_width * 0.15
    title = (F.col("kind") == "text") & (F.length(text) < 50) & (text.rlike(T.NUMBERED_TITLE) | centred)
    return found.join(first_lines, [*PAGE, "region"]).withColumn("kind", F.when(title, "title").otherwise(F.col("kind"))).drop("text")


def first_lines(blocks: DataFrame, spread: float = 1.5) -> DataFrame:
    """PAGE, region and text of the first line in reading order of each region that regions() finds."""
    mean = F.avg("h").over(Window.partitionBy(*PAGE))
    order = [F.col("y"), F.col("x"), F.col("idx")]
    rows = islands(blocks.withColumn("mean_h", mean), list(PAGE), order, F.col("y"), F.col("y") + F.col("h"), F.col("mean_h") * spread, "region")
    return rows.groupBy(*PAGE, "region").agg(F.min_by("text", F.struct("y", "x", "idx")).alias("text"))


def trimmed(cells: DataFrame, part: tuple[str, ...] = PAGE) -> DataFrame:
    """cells (part, row, col, text) without rows and columns that are blank throughout, numbered anew from 0. A grid without any text is gone."""
    full = cells.where(T.stripped(F.col("text")) != "")
    rows = full.select(*part, "row").distinct().withColumn("_row", F.row_number().over(Window.partitionBy(*part).orderBy("row")) - 1)
    cols = full.select(*part, "col").distinct().withColumn("_col", F.row_number().over(Window.partitionBy(*part).orderBy("col")) - 1)
    return cells.join(rows, [*part, "row"]).join(cols, [*part, "col"]).select(*part, F.col("_row").alias("row"), F.col("_col").alias("col"), "text")


def without_similar_lines(blocks: DataFrame, least: float = 0.7, most: int = 50, page_height: int = PAGE_HEIGHT) -> DataFrame:
    """blocks (doc_id, page, idx, text, y) without headers and footers that come on max(2, 30 %) of a document's pages or oftener, also in similar words.

    In order of page and line, a zone's lines are counted under an equal line before, or the first one similar (ratio of least or
    more; not looked for while there are `most` different ones), or themselves. Lines that are or resemble one of those often
    enough go, and with them the zone's page numbers. A document under three pages or without such a line stays as it is. Only
    lines of the zones come to a document's fold, as each step depends on the lines counted so far.
    """
    t = T.stripped(F.col("text"))
    zone = F.when(in_header(F.col("y"), page_height), "header").when(in_footer(F.col("y"), page_height), "footer")
    rows = blocks.withColumn("_t", t).withColumn("_zone", F.when(F.col("_t") != "", zone)).withColumn("_number", T.is_page_number(t))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages")).where("_pages >= 3")
    zoned = rows.where("_zone is not null").join(pages, "doc_id").select("doc_id", "_pages", "_zone", "page", "idx", "_t", "_number")
    key_type = dict(blocks.dtypes)["doc_id"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "idx"])
        counts: dict[str, dict[str, int]] = {"header": {}, "footer": {}}
        for r in pdf.itertuples(index=False, name=None):
            _, _, place, _, _, line, number = r
            known = counts[place]
            if line not in known and not number and len(known) < most:
                line = next((k for k in known if similarity_of(line, k, least) >= least), line)
            known[line] = known.get(line, 0) + 1
        enough = max(2, int(pdf["_pages"].iloc[0] * 0.3))
        often = {z: [k for k, c in known.items() if c >= enough] for z, known in counts.items()}
        out = []
        if any(often.values()):
            for place, line, number in sorted(set(zip(pdf["_zone"], pdf["_t"], pdf["_number"]))):
                if number or any(similarity_of(line, k, least) >= least for k in often[place]):
                    out.append((pdf["doc_id"].iloc[0], place, line))
        return pd.DataFrame(out, columns=["doc_id", "_zone", "_t"])

    gone = zoned.groupBy("doc_id").applyInPandas(fold, f"doc_id {key_type}, _zone string, _t string")
    return rows.join(gone, ["doc_id", "_zone", "_t"], "left_anti").select(*blocks.columns)


LISTS = "doc_id long, list int, type string, indent int, n_items int, markers string, content string, confidence double"


def lists(blocks: DataFrame) -> DataFrame:
    """Lists of two items or more, in order: runs of items of one type whose indent stays within one of the list's first.

    A line that is no item carries an item on if it does not end a sentence and is not left of it; any
    other line ends the list. Each step depends on the list so far, so Python folds the sorted lines of a task's documents one
    after the other; lines that are no item bring their text only if they can carry one on.
    """
    item, text = T.list_item(F.col("text")), T.stripped(F.col("text"))
    marked = blocks.select("doc_id", "idx", "conf", "x", text.alias("text"), item.alias("item"))
    carries = F.col("item").isNull() & (F.col("text") != "") & ~F.substring("text", -1, 1).isin(*"。！？.!?")
    rows = marked.select("doc_id", "idx", F.coalesce(F.col("conf").cast("double"), F.lit(float("nan"))).alias("conf"), F.col("x").cast("double").alias("x"), F.when(carries, F.col("text")).alias("text"), "item.type", "item.marker", "item.content")
    rows = rows.repartition("doc_id").withColumn("base", F.avg("x").over(Window.partitionBy("doc_id")))
    schema = pa.schema([("doc_id", pa.int64()), ("list", pa.int32()), ("type", pa.string()), ("indent", pa.int32()), ("n_items", pa.int32()), ("markers", pa.string()), ("content", pa.string()), ("confidence", pa.float64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        document, now, k = None, None, 0

        def close() -> None:
            nonlocal k
            if now is not None and len(now[2]) >= 2:
                items = now[2]
                contents = "|".join(" ".join(i[1]) for i in items)
                out.append((document, k, now[0], now[1], len(items), "|".join(i[0] for i in items), contents, round(sum(i[2] for i in items) / len(items), 4)))
                k += 1

        for batch in batches:
            for doc_id, conf, x, text, type_, marker, content, base in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id != document:
                    close()
                    document, now, k = doc_id, None, 0
                if type_ is not None:
                    shift = x - base
                    indent = 0 if shift < 20 else min(int(shift / 40), 3)
                    item = (marker, [content], conf, x)
                    if now is not None and now[0] == type_ and abs(indent - now[1]) <= 1:
                        now[2].append(item)
                    else:
                        close()
                        now = (type_, indent, [item])
                elif now is not None:
                    if text is not None and x >= now[2][-1][3] - 10:
                        now[2][-1][1].append(text)
                    else:
                        close()
                        now = None
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.sortWithinPartitions("doc_id", "idx").select("doc_id", "conf", "x", "text", "type", "marker", "content", "base").mapInArrow(fold, LISTS)
