"""Official notices as a structure: title, sections with subsections, signature and attachments, from a document's lines.

Everything is a window over a document's lines in order, so one exchange by document serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_group, stripped

# Patterns of a notice's parts (of SQL's and Java's common kind), words that lead in a subtitle, words that end the
# body, lines that count as page numbers, and how far above a date its organisation stands.
TITLE = r"(?s)关于.+?的(通知|通告|决定|函|报告|规定|办法)"
HEADER = r"^([\x{4e00}-\x{9fa5}]+(大学|学院)[\x{4e00}-\x{9fa5}]*学院[\x{4e00}-\x{9fa5}]*)"
REFERENCE = r"([\x{4e00}-\x{9fa5}]+字\s*[〔\[]?\d{4}[〕\]]?\s*\d+\s*号)"
SECTION = r"^[一二三四五六七八九十]+[、，,]\s*."
SUBSECTION = r"^\d+[、，,.]\s*."
BODY_ENDS = "此页无正文|印发|团总支|抄报|抄送"
COPIES = r"^抄[报送]"
DATE = r"^\d{4}\s*年"
LAST_DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
ORGANISATION = "团总支|委员会|学院|学校"
ATTACHMENT = r"^附件\s*[一二三四五六七八九十\d]"
SIGNATURE = r"^(抄[报送]|通报|昆明|共青团|\d{4}\s*年)"
LEAD_IN, LEAD_IN_NEXT = "学习|奋进|永远", "学习|奋进"
PAGE_DIGITS = tuple("123456789")
NEAR = 5


def numbered(lines: DataFrame) -> DataFrame:
    """doc_id, n (from 1) and line of a document's lines (doc_id, idx, line) without blank ones and single digits."""
    rows = lines.select("doc_id", "idx", stripped(F.col("line")).alias("line")).where((F.col("line") != "") & ~F.col("line").isin(*PAGE_DIGITS))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).alias("n"), "line")


def titles(rows: DataFrame) -> DataFrame:
    """rows of numbered() with title: the line from which a title begins, joined with one or two lines after it if it needs them."""
    w = Window.partitionBy("doc_id").orderBy("n")
    one, two, three = F.col("line"), F.concat("line", F.lead("line", 1).over(w)), F.concat("line", F.lead("line", 1).over(w), F.lead("line", 2).over(w))
    found = F.lit(None).cast("string")
    for text in (three, two, one):
        found = F.when(text.rlike(TITLE), text).otherwise(found)
    return rows.withColumn("title", found)


def roles(rows: DataFrame) -> DataFrame:
    """rows of numbered() with role (section, subsection, content; null outside the body), section and subsection: the n of their headings.

    A section goes on to the next one or to a line that ends the body; numbered lines within it are subsections.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    is_section, numbered_line = F.col("line").rlike(SECTION), F.col("line").rlike(SUBSECTION)
    marks = rows.withColumns({"_section": is_section, "_sub": numbered_line & ~is_section, "_end": F.col("line").rlike(BODY_ENDS) & ~is_section & ~numbered_line})
    marks = marks.withColumns({"section": F.max(F.when(F.col("_section"), F.col("n"))).over(w), "_ended": F.max(F.when(F.col("_end"), F.col("n"))).over(w)})
    is_open = F.col("section").isNotNull() & (F.coalesce("_ended", F.lit(0)) < F.col("section"))
    marks = marks.withColumn("section", F.when(is_open, F.col("section")))
    last_sub = F.max(F.when(F.col("_sub") & F.col("section").isNotNull(), F.col("n"))).over(w)
    marks = marks.withColumn("subsection", F.when(last_sub > F.col("section"), last_sub))
    role = F.when(F.col("section").isNull(), None).when(F.col("_section"), "section").when(F.col("_sub"), "subsection").otherwise("content")
    return marks.withColumn("role", role).select(*rows.columns, "role", "section", "subsection")


def signatures(rows: DataFrame) -> DataFrame:
    """rows of numbered() with kind (cc, distribution, date) and signs: on a line that begins with a year, the organisation that
    stands nearest above it, five lines up at most, unless that line is itself of a kind."""
    w = Window.partitionBy("doc_id").orderBy("n")
    kind = F.when(F.col("line").rlike(COPIES), "cc").when(F.col("line").contains("通报") & F.col("line").contains("支部"), "distribution").when(F.col("line").rlike(DATE), "date")
    organisation = F.col("line").rlike(ORGANISATION) & (F.length("line") > 4)
    marks = rows.withColumn("kind", kind)
    above = F.last(F.when(organisation, F.struct("n", "line", "kind")), ignorenulls=True).over(w.rowsBetween(-NEAR, -1))
    marks = marks.withColumn("_above", above)
    return marks.withColumn("signs", F.when(F.col("line").rlike(DATE) & F.col("_above.kind").isNull(), F.col("_above.line"))).drop("_above")


def attachments(rows: DataFrame) -> DataFrame:
    """rows of numbered() with attachment, the n of the attachment's name at or above, and in_attachment: a line of its content."""
    w = Window.partitionBy("doc_id").orderBy("n")
    name = F.col("line").rlike(ATTACHMENT)
    marks = rows.withColumn("attachment", F.max(F.when(name, F.col("n"))).over(w))
    return marks.withColumn("in_attachment", F.col("attachment").isNotNull() & ~name & ~F.col("line").rlike(SIGNATURE))


def marked(lines: DataFrame) -> DataFrame:
    """All of the above on a document's lines (doc_id, idx, line)."""
    return attachments(signatures(roles(titles(numbered(lines)))))


def _at_first(value: Column, where: Column) -> Column:
    return F.min_by(value, F.when(where, F.col("n")))


def summaries(rows: DataFrame) -> DataFrame:
    """One row a document of marked(): header, ref_number, title, subtitle, organisation, date, copies, distribution, and numbers of sections and attachments.

    The subtitle is the line after the title, if it leads in, or the two after it, in a document with quotation marks whose title is one line.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    known = rows.withColumns({"_one": F.lead("line", 1).over(w), "_two": F.lead("line", 2).over(w), "_header": first_group(F.col("line"), HEADER), "_ref": first_group(F.col("line"), REFERENCE), "_date": F.get(F.reverse(F.regexp_extract_all("line", F.lit(f"({LAST_DATE})"))), F.lit(0))})
    led = F.when(F.col("_one").rlike(LEAD_IN), F.col("_one")).when(F.col("_two").rlike(LEAD_IN_NEXT), F.concat_ws(" ", "_one", "_two"))
    of_title = F.min_by(F.struct("title", (F.col("title") == F.col("line")).alias("_whole"), "line", led.alias("led")), F.when(F.col("title").isNotNull(), F.col("n")))
    quoted = F.max(F.col("line").rlike("[“”]"))
    of_kind = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "line")))), lambda x: x["line"])
    out = known.groupBy("doc_id").agg(
        _at_first(F.col("_header"), F.col("_header").isNotNull()).alias("header"), _at_first(F.col("_ref"), F.col("_ref").isNotNull()).alias("ref_number"), of_title.alias("_t"), quoted.alias("_q"),
        _at_first(F.col("signs"), F.col("signs").isNotNull()).alias("organisation"),
        F.coalesce(_at_first(F.col("line"), F.col("kind") == "date"), F.max_by("_date", F.when(F.col("_date").isNotNull(), F.col("n")))).alias("date"),
        of_kind("cc").alias("copies"), F.get(F.reverse(of_kind("distribution")), F.lit(0)).alias("distribution"),
        F.count_if(F.col("role") == "section").alias("sections"), F.count_if(F.col("attachment") == F.col("n")).alias("attachments"),
    )
    subtitle = F.when(F.col("_q") & F.col("_t._whole"), F.col("_t.led"))
    return out.select("doc_id", "header", "ref_number", F.col("_t.title").alias("title"), subtitle.alias("subtitle"), "organisation", "date", "copies", "distribution", "sections", "attachments")


def sections(rows: DataFrame) -> DataFrame:
    """doc_id, section, subsection (null for the section itself), heading and content (lines by line breaks) of marked() rows."""
    body = rows.where("role is not null")
    at = F.col("n") == F.coalesce("subsection", "section")
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "content", F.struct("n", "line")))), lambda x: x["line"])
    return body.groupBy("doc_id", "section", "subsection").agg(F.max(F.when(at, F.col("line"))).alias("heading"), F.array_join(texts, "\n").alias("content"))


def attached(rows: DataFrame) -> DataFrame:
    """doc_id, attachment (its place), name and content of marked() rows."""
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("in_attachment"), F.struct("n", "line")))), lambda x: x["line"])
    return rows.where("attachment is not null").groupBy("doc_id", "attachment").agg(F.max(F.when(F.col("n") == F.col("attachment"), F.col("line"))).alias("name"), F.array_join(texts, "\n").alias("content"))


def documents(lines: DataFrame) -> DataFrame:
    """summaries() of lines with body (sections in order: heading, content, subsections) and attached (name, content)."""
    rows = marked(lines)
    parts = sections(rows).groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("subsection").isNull(), F.struct("heading", "content"))).alias("own"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("subsection").isNotNull(), F.struct("subsection", "heading", "content")))), lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"))).alias("subsections"),
    )
    body = parts.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section", "own", "subsections"))), lambda s: F.struct(s["own"]["heading"].alias("heading"), s["own"]["content"].alias("content"), s["subsections"].alias("subsections"))).alias("body"))
    names = attached(rows).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("attachment", "name", "content"))), lambda a: F.struct(a["name"].alias("name"), a["content"].alias("content"))).alias("attached"))
    return summaries(rows).join(body, "doc_id", "left").join(names, "doc_id", "left")
