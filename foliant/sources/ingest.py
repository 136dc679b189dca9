"""File arrival: names, stability, validation, text-or-scan decision, and parsing of recognition answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

# Limits and error codes of file checks.
MAX_BYTES, MAX_PAGES, WARN_PAGES, TEXT_PAGE_CHARS = 500 * 1024 * 1024, 2000, 100, 300
MAGIC = {"pdf": "25504446", "png": "89504E47", "jpg": "FFD8FF", "zip": "504B0304"}
KINDS = {"pdf": ("pdf",), "image": ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp"), "docx": ("doc", "docx"), "xlsx": ("xls", "xlsx"), "audio": ("mp3", "wav", "m4a")}


def watched(name: Column) -> Column:
    """Whether a file of this name is taken in: PDF, and neither hidden nor temporary."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(base).endswith(".pdf") & ~base.rlike("^[~.]")


def stable(listings: DataFrame) -> DataFrame:
    """path and the first time at which its size (not 0) equals that of the listing before: path, seen_at, length."""
    w = Window.partitionBy("path").orderBy("seen_at")
    same = listings.withColumn("_before", F.lag("length").over(w)).where("length = _before and length > 0")
    return same.groupBy("path").agg(F.min("seen_at").alias("stable_at"), F.min_by("length", "seen_at").alias("length"))


def validated(files: DataFrame) -> DataFrame:
    """files (exists, name, length, readable, encrypted, pages) with error_code of the first check that fails, and warnings."""
    code = (
        F.when(~F.col("exists"), "FILE_NOT_FOUND")
        .when(~F.lower("name").endswith(".pdf"), "INVALID_EXTENSION")
        .when(F.col("length") == 0, "EMPTY_FILE")
        .when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE")
        .when(~F.col("readable"), "PDF_CORRUPTED")
        .when(F.col("encrypted"), "PDF_ENCRYPTED")
        .when(F.col("pages") == 0, "EMPTY_PDF")
        .when(F.col("pages") > MAX_PAGES, "TOO_MANY_PAGES")
    )
    warnings = F.array_compact(F.array(F.when(code.isNull() & (F.col("pages") > WARN_PAGES), "MANY_PAGES")))
    return files.withColumn("error_code", code).withColumn("warnings", warnings).withColumn("is_valid", code.isNull())


def text_at_ingest(pages: DataFrame) -> DataFrame:
    """doc_id and is_text: whether each of its first three pages (doc_id, page from 0, chars) has text enough."""
    return pages.where("page < 3").groupBy("doc_id").agg((F.min("chars") >= TEXT_PAGE_CHARS).alias("is_text"))


def text_kind(pages: DataFrame) -> DataFrame:
    """Per document: sampled pages (three each from head, middle and tail), share of text pages, and kind text, mixed or scan."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = pages.withColumn("n", n)
    p, middle = F.col("page"), F.floor(F.col("n") / 2)
    sampled = rows.where((p < 3) | (p >= F.col("n") - 3) | p.between(middle - 1, middle + 1))
    share = F.avg((F.col("chars") >= TEXT_PAGE_CHARS).cast("int"))
    out = sampled.groupBy("doc_id").agg(F.count("*").alias("sampled"), F.round(share, 4).alias("text_ratio"))
    return out.withColumn("kind", F.when(F.col("text_ratio") >= 0.8, "text").when(F.col("text_ratio") >= 0.2, "mixed").otherwise("scan"))


def file_kind(name: Column) -> Column:
    suffix = F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)
    out = F.lit("other")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), F.lit(kind)).otherwise(out)
    return out


def magic_kind(content: Column) -> Column:
    """The kind that a file's first bytes speak for; null for others."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Lines of recognition answers (doc_id, answer): JSON, JSON in a fence or in brackets within text, else plain lines.

    doc_id, idx, text and conf; items without text are left out, a missing confidence is 0.95, that of plain lines 0.90.
    """
    kind = "array<struct<text:string,confidence:double>>"
    body = F.col("answer")
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    items = F.coalesce(*[F.when(F.get_json_object(c, "$[0].text").isNotNull(), F.from_json(c, kind)) for c in (body, fenced, span)])
    plain = F.transform(F.split(body, "\n"), lambda t: F.struct(t.alias("text"), F.lit(0.90).alias("confidence")))
    rows = answers.select("doc_id", F.posexplode(F.coalesce(items, plain)).alias("idx", "i"))
    return rows.select("doc_id", "idx", stripped(F.col("i.text")).alias("text"), F.coalesce("i.confidence", F.lit(0.95)).alias("conf")).where("text <> ''")


def font_histogram(lines: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent font sizes of each document: doc_id, font, n, place."""
    counts = lines.groupBy("doc_id", "font").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines at 80 % of their document's largest font or more, or bold."""
    largest = F.max("font").over(Window.partitionBy("doc_id"))
    return lines.withColumn("_m", largest).where((F.col("font") >= F.col("_m") * 0.8) | F.col("bold")).drop("_m")


def selected_pages(pages: DataFrame, selections: DataFrame) -> DataFrame:
    """Pages (doc_id, page from 1) in their document's selection; all of a document without one."""
    rows = pages.join(selections, "doc_id", "left").withColumn("_s", F.sort_array(F.array_distinct(F.coalesce("selected", F.array().cast("array<int>")))))
    return rows.where((F.size("_s") == 0) | F.array_contains("_s", F.col("page"))).drop("_s", "selected")


def folder(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The PDF files of a folder as rows of path, modificationTime, length and content."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).where(watched(F.col("path")))
