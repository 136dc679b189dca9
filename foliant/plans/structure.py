"""Pages, regions, paragraphs, sections, tables and quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import boxes as B
from ..functions import text as T
from ..operators import grids as G
from ..operators import scores
from ..operators import structure as S
from .derived import BLOCKS_CTE, blocks

#: Lines in pages of one to three, of which many run on.
RUNNING = ("doc_id", "CAST(floor(idx / (1 + doc_id % 3)) AS INT) AS page", "idx", "conf", "CASE WHEN (doc_id + idx) % 5 = 0 OR length(line) < 2 THEN line ELSE lower(substring(line, 1, length(line) - 1)) END AS text")

STRIP = r"regexp_replace({}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"
TEXT = STRIP.format("text")
PAGE_NO = rf"regexp_matches({TEXT}, '{T.PAGE_NUMBER}')"
LEVEL = "CASE " + " ".join(rf"WHEN regexp_matches({TEXT}, '{p}') THEN {n}" for n, p in T.HEADINGS) + " END"
DENSE = rf"length(regexp_replace(text, '{T.TABLE_SYMBOLS}', '', 'g')) / greatest(length(text), 1) > 0.25"


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumn("level", T.heading_pattern_level(F.col("text")))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx and level of headings. The level is exploded, so that a filter on it does not compute it a second time."""
    level = T.heading_pattern_level(F.col("text"))
    return blocks(spark, sf_dir).select("doc_id", "idx", F.explode(F.array_compact(F.array(level))).alias("level"))


#: Boxes in three forms: points, a corner and a size, two corners; pages of two widths and one height.
PLACES = ("*", "CASE WHEN idx % 3 = 0 THEN array(named_struct('x', CAST(x AS DOUBLE), 'y', CAST(y AS DOUBLE)), named_struct('x', CAST(x + w AS DOUBLE), 'y', CAST(y + h AS DOUBLE))) END AS points", "CASE WHEN idx % 3 = 1 THEN x END AS left", "CASE WHEN idx % 3 = 2 THEN x + w END AS x1", "CASE WHEN page % 2 = 0 THEN 400 ELSE 1000 END AS page_width")
_CENTRED = "abs((x + w / 2) / CAST(CASE WHEN page % 2 = 0 THEN 400 ELSE 1000 END AS DOUBLE) - 0.5) < 0.1"


@query("heading_levels", f"""WITH {BLOCKS_CTE}, m AS (SELECT doc_id, median(font) AS mf FROM blocks GROUP BY 1),
f AS (SELECT b.doc_id, b.idx, {TEXT} AS t, b.font, b.bold, {_CENTRED} AS centred, b.y < 60 AS top, m.mf, CASE WHEN {TEXT} <> '' THEN coalesce({LEVEL}, CASE WHEN mf > 0 AND font > mf * 1.2 AND {_CENTRED} AND length({TEXT}) < 50 THEN 2 WHEN mf > 0 AND font > mf * 1.2 AND bold THEN 3 WHEN b.y < 60 AND length({TEXT}) < 30 THEN 1 END) END AS base FROM blocks b JOIN m USING (doc_id)),
u AS (SELECT *, greatest(1, greatest(1, base - CAST(top AND bold AS INT)) - CAST(centred AND bold AS INT)) AS up FROM f)
SELECT doc_id, idx, CAST(CASE WHEN base IS NULL THEN NULL WHEN mf > 0 AND font <= mf AND NOT bold AND NOT centred THEN least(5, up + 1) ELSE up END AS INT) AS level FROM u""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).selectExpr(*PLACES)
    median = rows.groupBy("doc_id").agg(F.median("font").alias("median"))
    box = F.coalesce(B.of_points(F.col("points")), B.of_size(F.col("left"), F.col("y"), F.col("w"), F.col("h")), B.of_corners(F.col("x1"), F.col("y"), F.col("x"), F.col("y") + F.col("h")))
    rows = rows.withColumns({"centred": B.centred(box, F.col("page_width")), "top": B.at_top(box, F.lit(1200))})
    level = T.heading_level(F.col("text"), F.col("font").cast("double"), F.col("median"), F.col("bold"), F.col("centred"), F.col("top"))
    return rows.join(median, "doc_id").select("doc_id", "idx", level.cast("int").alias("level"))


@query("page_number_filter", f"""WITH {BLOCKS_CTE}, n AS (SELECT doc_id, idx, CASE idx % 8 WHEN 0 THEN CAST(idx AS STRING) WHEN 1 THEN '- 3 -' WHEN 2 THEN '第 4 页' WHEN 3 THEN 'Page 12' WHEN 4 THEN 'xiv' WHEN 5 THEN '3 / 15' WHEN 6 THEN '12345' ELSE text END AS text FROM blocks)
SELECT doc_id, idx, text FROM n WHERE NOT {PAGE_NO}""")
def page_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).selectExpr("doc_id", "idx", "CASE idx % 8 WHEN 0 THEN CAST(idx AS STRING) WHEN 1 THEN '- 3 -' WHEN 2 THEN '第 4 页' WHEN 3 THEN 'Page 12' WHEN 4 THEN 'xiv' WHEN 5 THEN '3 / 15' WHEN 6 THEN '12345' ELSE text END AS text")
    return rows.where(~T.is_page_number(F.col("text")))


PARAGRAPHS_CTE = f"""{BLOCKS_CTE}, l AS (SELECT *, {TEXT} AS t FROM blocks WHERE NOT {PAGE_NO}),
m AS (SELECT *, max(y + h) OVER (PARTITION BY doc_id, page ORDER BY y, x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR y - before > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, idx) AS para FROM m),
paragraphs AS (SELECT doc_id, page, CAST(para AS INT) AS para, count(*) AS n_lines, string_agg(t, ' ' ORDER BY y, x, idx) AS text, avg(conf) AS confidence FROM s GROUP BY 1, 2, 3)"""


@query("paragraph_islands", f"WITH {PARAGRAPHS_CTE} SELECT * FROM paragraphs")
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paragraphs(blocks(spark, sf_dir))


REGIONS_CTE = f"""{BLOCKS_CTE}, a AS (SELECT *, avg(h) OVER (PARTITION BY doc_id, page) AS mh, max(y + h) OVER (PARTITION BY doc_id, page ORDER BY y, x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR y - before > mh * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, idx) AS region FROM a),
regions AS (SELECT doc_id, page, CAST(region AS INT) AS region, min(x) AS l, min(y) AS t, max(x + w) AS r, max(y + h) AS b, count(*) AS n_lines, avg(conf) AS confidence, count(*) FILTER ({DENSE}) AS n_dense, any_value(mh) AS mh FROM s GROUP BY 1, 2, 3)"""


@query("layout_regions", f"WITH {REGIONS_CTE} SELECT doc_id, page, region, l AS \"left\", t AS top, r AS \"right\", b AS bottom, n_lines, confidence, n_dense, CASE WHEN n_dense / n_lines >= 0.25 THEN 'table' ELSE 'text' END AS kind FROM regions")
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(blocks(spark, sf_dir)).drop("mean_h")


@query("reading_order", f"""WITH {REGIONS_CTE}, g AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, page ORDER BY region) - b AS gap FROM regions),
u AS (SELECT doc_id, page, CASE WHEN n_dense / n_lines >= 0.25 THEN 'table' ELSE 'text' END AS kind, CAST(l AS INT) AS "left", CAST(t AS INT) AS top, CAST(b - t AS INT) AS height FROM regions
 UNION ALL SELECT doc_id, page, 'image', 124, CAST(b + floor(gap * 0.1) AS INT), CAST(floor(least(gap, 1403.2) * 0.8) AS INT) FROM g WHERE gap > 4 * mh AND gap < 1754)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top, "left", kind) - 1 AS INT) AS reading_order FROM u""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_images(S.regions(blocks(spark, sf_dir)))


@query("column_count", f"""WITH {BLOCKS_CTE}, c AS (SELECT doc_id, page, (x + x + w) / 2 AS c FROM blocks), g AS (SELECT *, lead(c) OVER (PARTITION BY doc_id, page ORDER BY c) - c AS g FROM c), m AS (SELECT *, avg(g) OVER (PARTITION BY doc_id, page) AS mean FROM g)
SELECT doc_id, page, CAST(CASE WHEN count(*) < 3 THEN 1 ELSE least(count(*) FILTER (g > mean * 2.5 AND g > 198.4) + 1, 3) END AS INT) AS columns FROM m GROUP BY 1, 2""")
def column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("left", F.col("x")).withColumn("right", F.col("x") + F.col("w"))
    return S.column_count(rows)


@query("cluster_1d", f"""WITH {BLOCKS_CTE}, d AS (SELECT DISTINCT doc_id, page, y FROM blocks), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) <= 40 THEN 0 ELSE 1 END AS s FROM d), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y) AS r FROM g)
SELECT doc_id, page, CAST(r - 1 AS INT) AS number, avg(y) AS centre FROM r GROUP BY 1, 2, 3""")
def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clusters(blocks(spark, sf_dir), ["doc_id", "page"], "y", F.lit(40))


@query("table_grid", f"""WITH {BLOCKS_CTE}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, x + w / 2 AS cx, y + h / 2 AS cy FROM blocks), b AS (SELECT * FROM n WHERE n >= 2),
ry AS (SELECT DISTINCT doc_id, page, cy FROM b), rs AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy) <= 24 THEN 0 ELSE 1 END AS s FROM ry), rr AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY cy) - 1 AS k FROM rs), rc AS (SELECT doc_id, page, k, avg(cy) AS c FROM rr GROUP BY 1, 2, 3),
pr AS (SELECT b.*, (SELECT min_by(rc.k, abs(b.cy - rc.c) * 1000000 + rc.k) FROM rc WHERE rc.doc_id = b.doc_id AND rc.page = b.page) AS r FROM b),
cy AS (SELECT DISTINCT doc_id, page, r, cx FROM pr), cs AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc_id, page, r ORDER BY cx) <= 16 THEN 0 ELSE 1 END AS s FROM cy), cr AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page, r ORDER BY cx) AS k FROM cs), cc AS (SELECT doc_id, page, r, k, avg(cx) AS c FROM cr GROUP BY 1, 2, 3, 4),
gy AS (SELECT DISTINCT doc_id, page, c FROM cc), gs AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id, page ORDER BY c) <= 24 THEN 0 ELSE 1 END AS s FROM gy), gr AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY c) - 1 AS k FROM gs), gc AS (SELECT doc_id, page, k, avg(c) AS c FROM gr GROUP BY 1, 2, 3),
pc AS (SELECT pr.*, (SELECT min_by(gc.k, abs(pr.cx - gc.c) * 1000000 + gc.k) FROM gc WHERE gc.doc_id = pr.doc_id AND gc.page = pr.page) AS g FROM pr)
SELECT doc_id, page, CAST(r AS INT) AS row, CAST(g AS INT) AS col, string_agg(text, ' ' ORDER BY y, idx) AS text FROM pc GROUP BY 1, 2, 3, 4""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_cells(blocks(spark, sf_dir))


@query("section_assign", f"WITH {BLOCKS_CTE}, l AS (SELECT doc_id, idx, {LEVEL} AS level FROM blocks) SELECT doc_id, idx, CAST(max(CASE WHEN level IS NOT NULL THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS INT) AS section FROM l")
def section_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_of(_leveled(spark, sf_dir)).select("doc_id", "idx", "section")


TREE_CTE = f"""{BLOCKS_CTE}, hd AS (SELECT doc_id, idx, {LEVEL} AS level FROM blocks WHERE {LEVEL} IS NOT NULL),
tree AS (SELECT a.doc_id, a.idx, a.level, max(b.idx) AS parent FROM hd a LEFT JOIN hd b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY 1, 2, 3),
depths AS (SELECT doc_id, idx, 1 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.idx, d.depth + 1 FROM tree t JOIN depths d ON d.doc_id = t.doc_id AND d.idx = t.parent)"""


@query("section_parent", f"WITH RECURSIVE {TREE_CTE} SELECT t.doc_id, t.idx, CAST(level AS INT) AS level, CAST(parent AS INT) AS parent, CAST(depth AS INT) AS depth FROM tree t JOIN depths USING (doc_id, idx)")
def section_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_tree(_headings(spark, sf_dir)).drop("parent_level")


@query("level_skip", f"""WITH RECURSIVE {TREE_CTE}, p AS (SELECT t.*, coalesce(lag(t.level) OVER (PARTITION BY t.doc_id, t.parent ORDER BY t.idx), u.level, 0) AS before FROM tree t LEFT JOIN hd u ON u.doc_id = t.doc_id AND u.idx = t.parent)
SELECT doc_id, count(*) FILTER (before > 0 AND level > before + 1) AS skips, count(*) AS headings, count(DISTINCT level) AS levels FROM p GROUP BY 1""")
def level_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.level_skips(S.section_tree(_headings(spark, sf_dir)))


FILE_CTE = """f AS (SELECT source AS doc_id, CAST(dense_rank() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page, string_split(text, chr(10)) AS ls FROM documents),
bl AS (SELECT doc_id, page, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS idx, len(ls) AS n FROM f), b AS (SELECT doc_id, page, CAST(idx AS INT) AS idx, text, CAST(CASE WHEN idx = n - 1 AND n > 1 THEN 3400 ELSE idx * 60 END AS INT) AS y FROM bl)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a file, its documents as pages, the last line of a page at its foot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = (F.dense_rank().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int")
    split = docs.select(F.col("source").alias("doc_id"), page.alias("page"), F.split("text", "\n").alias("ls"))
    rows = split.select("doc_id", "page", F.size("ls").alias("n"), F.posexplode("ls").alias("idx", "text"))
    return rows.select("doc_id", "page", "idx", "text", F.when((F.col("idx") == F.col("n") - 1) & (F.col("n") > 1), 3400).otherwise(F.col("idx") * 60).alias("y"))


@query("repeated_line_removal", rf"""WITH {FILE_CTE}, z AS (SELECT *, {TEXT} AS t, CASE WHEN {TEXT} = '' THEN NULL WHEN y / 3508 < 0.05 OR y < 80 THEN 'header' WHEN y / 3508 > 0.92 OR y > 3388 THEN 'footer' END AS zone FROM b), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY 1),
r AS (SELECT z.doc_id, zone, t FROM z JOIN p USING (doc_id) WHERE zone IS NOT NULL AND pages >= 3 GROUP BY z.doc_id, zone, t, pages HAVING count(*) >= greatest(2, floor(pages * 0.3))), q AS (SELECT DISTINCT doc_id FROM r)
SELECT z.doc_id, page, idx, text, y FROM z WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = z.doc_id AND r.zone = z.zone AND r.t = z.t) AND NOT (zone IS NOT NULL AND regexp_matches(t, '{T.PAGE_NUMBER}') AND doc_id IN (SELECT doc_id FROM q))""")
def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_repeated_lines(_files(spark, sf_dir))


#: Pages of ten lines whose first and last lines are the same but for a number or a misread character.
STAMPED = ("doc_id", "page", "idx", "CASE idx % 10 WHEN 0 THEN concat('季度审计报告 内部资料 第', CAST(page + 1 AS STRING), '册', CASE WHEN doc_id % 3 = 0 THEN 'O' ELSE '0' END, CAST(doc_id AS STRING)) WHEN 9 THEN concat('打印于', CAST(page * 7 + 1 AS STRING), '室 档案科') ELSE line END AS text", "CASE idx % 10 WHEN 0 THEN 40 WHEN 9 THEN 3400 ELSE 200 + (idx % 10) * 60 END AS y")


@query("similar_line_removal")
def similar_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of its own; what an exact comparison would leave is told apart from it in tests."""
    return S.without_similar_lines(blocks(spark, sf_dir).selectExpr(*STAMPED))


@query("page_conf_weighted", f"""WITH {BLOCKS_CTE}, p AS (SELECT doc_id, page, round(sum(conf) / count(*), 4) AS c FROM blocks GROUP BY 1, 2)
SELECT d.doc_id, d.confidence, pages, deviation, low_pages FROM (SELECT doc_id, round(sum(conf) / count(*), 4) AS confidence FROM blocks GROUP BY 1) d JOIN (SELECT doc_id, count(*) AS pages, coalesce(round(stddev_samp(c), 4), 0.0) AS deviation, count(*) FILTER (c < 60) AS low_pages FROM p GROUP BY 1) USING (doc_id)""")
def page_conf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_confidence(blocks(spark, sf_dir))


OPEN = rf"{STRIP.format('lt')} <> '' AND NOT regexp_matches({STRIP.format('lt')}, '^\d{{1,4}}$') AND NOT regexp_matches({STRIP.format('lt')}, '{T.TERMINAL}')"
ON = rf"regexp_matches({STRIP.format('nt')}, '{T.CONTINUES}') AND NOT regexp_matches({STRIP.format('nt')}, '{T.CHAPTER}')"
RUNNING_CTE = f"""{BLOCKS_CTE}, running AS (SELECT {', '.join(RUNNING)} FROM blocks),
ends AS (SELECT doc_id, page, arg_min(text, idx) AS ft, min(idx) AS fi, arg_min(conf, idx) AS fc, arg_max(text, idx) AS lt, max(idx) AS li, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM running GROUP BY 1, 2),
met AS (SELECT *, lead(ft) OVER w AS nt, lead(fi) OVER w AS ni, lead(fc) OVER w AS nc, lead(page) OVER w AS np FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
fits AS (SELECT *, coalesce(np = page + 1 AND {OPEN} AND {ON}, false) AS fits FROM met)"""


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).selectExpr(*RUNNING)


@query("cross_page_merge", f"WITH {RUNNING_CTE} SELECT doc_id, page, CAST(li AS INT) AS idx, CAST(ni AS INT) AS next_idx FROM fits WHERE fits")
def cross_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cross_page(_running(spark, sf_dir))


@query("cross_page_merged_text", f"""WITH RECURSIVE {RUNNING_CTE}, r AS (SELECT doc_id, k, fits AS takes FROM fits WHERE k = 1 UNION ALL SELECT f.doc_id, f.k, f.fits AND NOT (f.n = 1 AND r.takes) FROM r JOIN fits f ON f.doc_id = r.doc_id AND f.k = r.k + 1),
t AS (SELECT f.* FROM fits f JOIN r USING (doc_id, k) WHERE takes)
SELECT b.doc_id, b.page, b.idx, CASE WHEN t.li IS NULL THEN b.text ELSE b.text || {STRIP.format('t.nt')} END AS text, CAST(CASE WHEN t.li IS NULL THEN b.conf ELSE round((b.conf + t.nc) / 2, 4) END AS DOUBLE) AS confidence, t.np AS next_page
FROM running b LEFT JOIN t ON t.doc_id = b.doc_id AND t.li = b.idx WHERE NOT EXISTS (SELECT 1 FROM t g WHERE g.doc_id = b.doc_id AND g.ni = b.idx)""")
def cross_page_merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cross_page_merged(_running(spark, sf_dir))


@query("document_tree", f"""WITH RECURSIVE {BLOCKS_CTE}, l AS (SELECT *, {TEXT} AS t, {LEVEL} AS level FROM blocks WHERE {TEXT} <> '' AND NOT {PAGE_NO}),
hd AS (SELECT doc_id, idx, t, level FROM l WHERE level IS NOT NULL),
tree AS (SELECT a.doc_id, a.idx, a.level, a.t, max(b.idx) AS parent FROM hd a LEFT JOIN hd b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY 1, 2, 3, 4),
depths AS (SELECT doc_id, idx, 1 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.idx, d.depth + 1 FROM tree t JOIN depths d ON d.doc_id = t.doc_id AND d.idx = t.parent),
body AS (SELECT *, coalesce((SELECT max(hd.idx) FROM hd WHERE hd.doc_id = l.doc_id AND hd.idx < l.idx), -1) AS s FROM l WHERE level IS NULL),
m AS (SELECT *, max(y + h) OVER (PARTITION BY doc_id, s, page ORDER BY y, x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM body),
p AS (SELECT *, sum(CASE WHEN before IS NULL OR y - before > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s, page ORDER BY y, x, idx) AS para FROM m),
q AS (SELECT doc_id, s, page, para, string_agg(t, ' ' ORDER BY y, x, idx) AS t FROM p GROUP BY 1, 2, 3, 4),
o AS (SELECT doc_id, s, string_agg(t, chr(10) ORDER BY page, para) AS paragraphs, count(*) AS n FROM q GROUP BY 1, 2),
a AS (SELECT coalesce(t.doc_id, o.doc_id) AS doc_id, t.idx AS section, t.level, t.t AS title, t.parent, d.depth, coalesce(o.paragraphs, '') AS paragraphs, coalesce(o.n, 0) AS n FROM tree t JOIN depths d USING (doc_id, idx) FULL JOIN o ON o.doc_id = t.doc_id AND o.s = t.idx)
SELECT doc_id, CAST(section AS INT) AS section, CAST(level AS INT) AS level, title, CAST(parent AS INT) AS parent, CAST(depth AS INT) AS depth, paragraphs, count(section) OVER (PARTITION BY doc_id) AS sections_in_all, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS paragraphs_in_all FROM a""")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_tree(_leveled(spark, sf_dir)).withColumn("paragraphs", F.array_join("paragraphs", "\n"))


@query("region_titles", rf"""WITH {REGIONS_CTE}, f AS (SELECT doc_id, page, CAST(region AS INT) AS region, arg_min(text, y * 1000000 + x * 1000 + idx % 1000) AS text FROM s GROUP BY 1, 2, 3)
SELECT doc_id, page, region, CASE WHEN n_dense / n_lines >= 0.25 THEN 'table' WHEN length(text) < 50 AND (regexp_matches(text, '{T.NUMBERED_TITLE}') OR abs((l + r) / 2 - 1240) < 372) THEN 'title' ELSE 'text' END AS kind FROM regions JOIN f USING (doc_id, page, region)""")
def region_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    return S.with_titles(S.regions(rows), S.first_lines(rows)).select("doc_id", "page", "region", "kind")


@query("table_trimmed", f"""WITH {BLOCKS_CTE}, c AS (SELECT doc_id, page, idx % 3 AS row, (idx // 3) % 4 AS col, CASE WHEN (doc_id + idx % 3) % 3 = 0 OR (doc_id + (idx // 3) % 4) % 5 = 0 THEN ' ' ELSE substring(line, 1, 5) END AS text FROM blocks),
f AS (SELECT * FROM c WHERE {TEXT} <> ''), r AS (SELECT doc_id, page, row, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS nr FROM (SELECT DISTINCT doc_id, page, row FROM f)), k AS (SELECT doc_id, page, col, row_number() OVER (PARTITION BY doc_id, page ORDER BY col) - 1 AS nc FROM (SELECT DISTINCT doc_id, page, col FROM f))
SELECT doc_id, page, CAST(nr AS INT) AS row, CAST(nc AS INT) AS col, text FROM c JOIN r USING (doc_id, page, row) JOIN k USING (doc_id, page, col)""")
def table_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = blocks(spark, sf_dir).selectExpr("doc_id", "page", "idx % 3 AS row", "(idx div 3) % 4 AS col", "CASE WHEN (doc_id + idx % 3) % 3 = 0 OR (doc_id + (idx div 3) % 4) % 5 = 0 THEN ' ' ELSE substring(line, 1, 5) END AS text")
    return S.trimmed(cells)


COUNTS = (
    "CAST(o_orderkey AS BIGINT) AS doc_id", "(o_orderkey % 101) / 100.0D AS confidence", "CAST(o_orderkey % 9 AS INT) AS pages", "CAST(least(o_orderkey % 9, o_custkey % 4) AS INT) AS low_pages", "CAST(least(o_orderkey % 9, o_custkey % 3) AS INT) AS empty_pages",
    "(o_custkey % 30) / 100.0D AS deviation", "CAST(o_custkey % 2 AS INT) AS very_low_pages", "CAST(o_orderkey % 4 AS INT) AS sections", "CAST(o_orderkey % 4 AS INT) AS depth", "CAST(o_custkey % 8 AS INT) AS paragraphs", "CAST(o_custkey % 5 AS INT) AS orphans", "CAST(o_custkey % 3 AS INT) AS skips",
    "CAST(o_orderkey % 12 AS INT) AS headings", "CAST(1 + o_custkey % 2 AS INT) AS levels", "CAST(o_custkey % 3 AS INT) AS lists", "CAST(o_orderkey % 10 AS INT) AS list_items", "CAST(o_orderkey % 3 AS INT) AS tables", "CAST(o_custkey % 2 AS INT) AS filled_tables",
)


#: Scores and warnings of d, the counts of documents.
SCORED = """scored AS (SELECT doc_id,
 round(greatest(0, least(confidence, 1) - CASE WHEN pages > 0 THEN low_pages / pages * CAST(0.2 AS DOUBLE) ELSE 0 END), 4) AS ocr,
 round(least(1, (CASE WHEN sections > 0 THEN CAST(0.4 AS DOUBLE) + CASE WHEN depth >= 3 THEN CAST(0.3 AS DOUBLE) WHEN depth >= 2 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END ELSE 0 END + CASE WHEN paragraphs > 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN paragraphs >= 5 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) * CASE WHEN orphans / greatest(paragraphs, 1) < 0.2 THEN CAST(1 AS DOUBLE) WHEN orphans / greatest(paragraphs, 1) < 0.5 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END), 4) AS structure,
 round(CASE WHEN sections > 0 THEN greatest(0, least(1, CAST(0.7 AS DOUBLE) - CAST(0.05 AS DOUBLE) * skips - CASE WHEN levels < 2 AND headings > 5 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)) ELSE 0 END, 4) AS heading,
 round(least(1, CAST(0.5 AS DOUBLE) + CASE WHEN lists > 0 THEN CAST(0.15 AS DOUBLE) + CASE WHEN list_items / lists >= 3 THEN CAST(0.1 AS DOUBLE) ELSE 0 END ELSE 0 END + CASE WHEN tables > 0 THEN CAST(0.15 AS DOUBLE) + CASE WHEN filled_tables > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END ELSE 0 END), 4) AS data,
 round(greatest(0, CAST(1 AS DOUBLE) - CASE WHEN empty_pages / greatest(pages, 1) > 0.3 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) * empty_pages END - CASE WHEN deviation > 0.2 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN very_low_pages > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN sections = 0 AND paragraphs = 0 THEN CAST(0.3 AS DOUBLE) ELSE 0 END), 4) AS anomaly FROM d)
SELECT doc_id, ocr, structure, heading, data, anomaly, CAST(round(CAST(ocr AS DECIMAL(6,4)) * 0.35 + CAST(structure AS DECIMAL(6,4)) * 0.25 + CAST(heading AS DECIMAL(6,4)) * 0.20 + CAST(data AS DECIMAL(6,4)) * 0.10 + CAST(anomaly AS DECIMAL(6,4)) * 0.10, 4) AS DOUBLE) AS total,
 concat_ws(',', CASE WHEN CAST(ocr AS DECIMAL(6,4)) * 0.35 + CAST(structure AS DECIMAL(6,4)) * 0.25 + CAST(heading AS DECIMAL(6,4)) * 0.20 + CAST(data AS DECIMAL(6,4)) * 0.10 + CAST(anomaly AS DECIMAL(6,4)) * 0.10 < 0.5 THEN 'low_overall_quality' END, CASE WHEN ocr < 0.5 THEN 'poor_ocr_quality' END, CASE WHEN structure < 0.3 THEN 'insufficient_structure' END) AS warnings FROM scored"""


@query("quality_score", f"""WITH d AS (SELECT {', '.join(COUNTS).replace('100.0D', 'CAST(100 AS DOUBLE)')} FROM orders),
{SCORED}""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*COUNTS))


@query("list_items", f"""WITH {BLOCKS_CTE}, t AS (SELECT doc_id, idx, {TEXT} AS t FROM blocks)
SELECT doc_id, idx, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in T.LIST_ITEMS)} END AS type, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for _, p in T.LIST_ITEMS)} END AS marker FROM t""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "idx", T.list_item(F.col("text")).alias("i")).select("doc_id", "idx", "i.type", "i.marker")


_OF_ITEM = lambda value: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {value(k, p)}" for k, p in T.LIST_ITEMS) + " END"
#: Lines of documents with what a walk over them knows: the list and item that each is in; kept: lists of two items or more.
LISTS_CTE = f"""li AS (SELECT doc_id, idx, {TEXT} AS t, conf, x, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k, avg(x) OVER (PARTITION BY doc_id) AS base FROM blocks),
lj AS (SELECT *, {_OF_ITEM(lambda k, p: f"'{k}'")} AS type, {_OF_ITEM(lambda k, p: f"regexp_extract(t, '{p}', 1)")} AS marker, {_OF_ITEM(lambda k, p: STRIP.format(f"regexp_replace(t, '{p}', '')"))} AS content, CASE WHEN x - base < 20 THEN 0 ELSE least(CAST(trunc((x - base) / 40) AS INT), 3) END AS indent FROM li),
lr AS (SELECT doc_id, idx, k, type AS ct, CASE WHEN type IS NOT NULL THEN indent END AS ci, CASE WHEN type IS NOT NULL THEN x END AS cx, CASE WHEN type IS NOT NULL THEN 1 ELSE 0 END AS list, CASE WHEN type IS NOT NULL THEN 1 ELSE 0 END AS item FROM lj WHERE k = 1
 UNION ALL SELECT doc_id, idx, k, CASE WHEN type IS NOT NULL THEN type WHEN carries THEN ct END, CASE WHEN goes THEN ci WHEN type IS NOT NULL THEN indent WHEN carries THEN ci END, CASE WHEN type IS NOT NULL THEN x WHEN carries THEN cx END, list + CAST(type IS NOT NULL AND NOT goes AS INT), item + CAST(type IS NOT NULL AS INT)
 FROM (SELECT j.doc_id, j.idx, j.k, j.type, j.indent, j.x, r.ct, r.ci, r.cx, r.list, r.item, coalesce(r.ct = j.type AND abs(j.indent - r.ci) <= 1, false) AS goes, coalesce(r.ct IS NOT NULL AND j.t <> '' AND NOT contains('。！？.!?', right(j.t, 1)) AND j.x >= r.cx - 10, false) AS carries FROM lr r JOIN lj j ON j.doc_id = r.doc_id AND j.k = r.k + 1)),
lt AS (SELECT lr.doc_id, list, item, max(ct) AS type, max(ci) AS indent, max(marker) AS marker, string_agg(CASE WHEN type IS NOT NULL THEN content ELSE t END, ' ' ORDER BY lr.idx) AS content, max(CASE WHEN type IS NOT NULL THEN conf END) AS conf FROM lr JOIN lj ON lj.doc_id = lr.doc_id AND lj.k = lr.k WHERE ct IS NOT NULL GROUP BY 1, 2, 3),
kept AS (SELECT doc_id, list, max(type) AS type, max(indent) AS indent, count(*) AS n_items, string_agg(marker, '|' ORDER BY item) AS markers, string_agg(content, '|' ORDER BY item) AS content, round(avg(conf), 4) AS confidence FROM lt GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("list_groups", f"WITH RECURSIVE {BLOCKS_CTE}, {LISTS_CTE} SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list) - 1 AS INT) AS list, CAST(indent AS INT) AS indent, CAST(n_items AS INT) AS n_items) FROM kept")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lists(blocks(spark, sf_dir))


@query("document_quality", f"""WITH RECURSIVE {REGIONS_CTE}, {LISTS_CTE}, l AS (SELECT *, {TEXT} AS t, {LEVEL} AS level FROM blocks WHERE {TEXT} <> '' AND NOT {PAGE_NO}), hd AS (SELECT doc_id, idx, level FROM l WHERE level IS NOT NULL),
tree AS (SELECT a.doc_id, a.idx, a.level, max(b.idx) AS parent FROM hd a LEFT JOIN hd b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY 1, 2, 3),
depths AS (SELECT doc_id, idx, 1 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.idx, d.depth + 1 FROM tree t JOIN depths d ON d.doc_id = t.doc_id AND d.idx = t.parent),
sk AS (SELECT t.*, coalesce(lag(t.level) OVER (PARTITION BY t.doc_id, t.parent ORDER BY t.idx), p.level, 0) AS above FROM tree t LEFT JOIN hd p ON p.doc_id = t.doc_id AND p.idx = t.parent),
body AS (SELECT *, coalesce((SELECT max(hd.idx) FROM hd WHERE hd.doc_id = l.doc_id AND hd.idx < l.idx), -1) AS s FROM l WHERE level IS NULL),
bm AS (SELECT *, max(y + h) OVER (PARTITION BY doc_id, s, page ORDER BY y, x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM body),
q AS (SELECT doc_id, count(*) FILTER (before IS NULL OR y - before > 80) AS paragraphs, count(*) FILTER (s = -1 AND (before IS NULL OR y - before > 80)) AS orphans FROM bm GROUP BY 1),
c AS (SELECT t.doc_id, count(*) AS sections, max(depth) AS depth, count(DISTINCT t.level) AS levels, count(*) FILTER (above > 0 AND t.level > above + 1) AS skips FROM sk t JOIN depths USING (doc_id, idx) GROUP BY 1),
pm AS (SELECT doc_id, page, round(avg(conf) / 100, 4) AS mean FROM blocks GROUP BY 1, 2), pc AS (SELECT doc_id, max(page) + 1 AS pages, count(*) AS seen, count(*) FILTER (mean < 0.6) AS low, coalesce(stddev_samp(mean) FILTER (mean > 0), 0) AS deviation, count(*) FILTER (mean > 0 AND mean < 0.3) AS very FROM pm GROUP BY 1),
dc AS (SELECT doc_id, round(avg(conf) / 100, 4) AS confidence FROM blocks GROUP BY 1), lc AS (SELECT doc_id, count(*) AS lists, sum(n_items) AS items FROM kept GROUP BY 1),
tc AS (SELECT doc_id, count(*) FILTER (n_dense / n_lines >= 0.25) AS tables, count(*) FILTER (n_dense / n_lines >= 0.25 AND n_lines >= 2) AS filled FROM regions GROUP BY 1),
d AS (SELECT dc.doc_id, confidence, pages, low + pages - seen AS low_pages, pages - seen AS empty_pages, deviation, very AS very_low_pages, coalesce(sections, 0) AS sections, coalesce(depth, 0) AS depth, coalesce(paragraphs, 0) AS paragraphs, coalesce(orphans, 0) AS orphans, coalesce(skips, 0) AS skips, coalesce(sections, 0) AS headings, coalesce(levels, 0) AS levels, coalesce(lists, 0) AS lists, coalesce(items, 0) AS list_items, tables, filled AS filled_tables
 FROM dc JOIN pc USING (doc_id) JOIN tc USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN lc USING (doc_id)),
{SCORED.replace("AS warnings FROM scored", "AS warnings, sections, paragraphs, orphans, skips, lists, list_items, tables, empty_pages FROM scored JOIN d USING (doc_id)")}""")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the lines themselves, with the counts behind them."""
    found = scores.counts(blocks(spark, sf_dir))
    return S.quality(found, "sections", "paragraphs", "orphans", "skips", "lists", "list_items", "tables", "empty_pages")


CELLS = "CASE WHEN (doc_id + idx) % 4 = 0 OR (doc_id + idx) % 7 = 1 THEN ' ' ELSE substring(line, 1, CAST(1 + (doc_id + idx) % 260 AS INT)) END"


@query("table_html", f"""WITH {BLOCKS_CTE}, g AS (SELECT doc_id, page, CAST((idx % 10) // 4 AS INT) AS row, CAST((idx % 10) % 4 AS INT) AS col, {CELLS} AS text FROM blocks), z AS (SELECT doc_id, page, max(row) + 1 AS nr, max(col) + 1 AS nc FROM g GROUP BY 1, 2),
f AS (SELECT doc_id, page, row, col, {TEXT} AS text FROM g WHERE {TEXT} <> ''),
e AS (SELECT *, coalesce(lead(col) OVER (PARTITION BY doc_id, page, row ORDER BY col), nc) AS fin FROM f JOIN z USING (doc_id, page)),
s AS (SELECT a.doc_id, a.page, a.row, a.col, coalesce(min(b.row), any_value(a.nr)) - a.row AS rs, any_value(a.fin) - a.col AS cs, any_value(a.text) AS text FROM e a LEFT JOIN f b ON b.doc_id = a.doc_id AND b.page = a.page AND b.row > a.row AND b.col < a.fin GROUP BY 1, 2, 3, 4),
u AS (SELECT doc_id, page, row, col, 1 AS rs, 1 AS cs, '' AS text FROM (SELECT doc_id, page, unnest(range(nr)) AS row, nc FROM z) r, unnest(range(nc)) AS t(col) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = r.doc_id AND s.page = r.page AND r.row >= s.row AND r.row < s.row + s.rs AND t.col >= s.col AND t.col < s.col + s.cs)),
c AS (SELECT doc_id, page, row, col, '<td' || CASE WHEN rs > 1 THEN ' rowspan="' || rs || '"' ELSE '' END || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || '>' || replace(replace(replace(left(text, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END || '</td>' AS td FROM (SELECT * FROM s UNION ALL SELECT * FROM u)),
r AS (SELECT z.doc_id, z.page, k.row, concat_ws(chr(10), '<tr>', string_agg(td, chr(10) ORDER BY col), '</tr>') AS tr, any_value(nr) AS nr FROM z, unnest(range(nr)) AS k(row) LEFT JOIN c ON c.doc_id = z.doc_id AND c.page = z.page AND c.row = k.row GROUP BY 1, 2, 3)
SELECT doc_id, page, concat_ws(chr(10), '<table class="table">', CASE WHEN any_value(nr) > 1 THEN concat_ws(chr(10), '<thead>', max(tr) FILTER (row = 0), '</thead>') END, '<tbody>', string_agg(tr, chr(10) ORDER BY row) FILTER (row > 0 OR nr = 1), '</tbody>', '</table>') AS html FROM r GROUP BY 1, 2""")
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's ten lines as a grid of four columns, some of its places empty."""
    cells = blocks(spark, sf_dir).selectExpr("doc_id", "page", "CAST((idx % 10) div 4 AS INT) AS row", "CAST((idx % 10) % 4 AS INT) AS col", f"{CELLS} AS text")
    return G.html_of(G.grids(cells))


@query("similarity_fuzzy")
def similarity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(S.in_header(F.col("y")), "header").when(S.in_footer(F.col("y")), "footer")
    rows = blocks(spark, sf_dir).select("doc_id", zone.alias("zone"), F.col("line").alias("text"))
    return S.fuzzy_repeats(rows.where("zone is not null"))


@query("table_row_density", f"WITH {BLOCKS_CTE}, l AS (SELECT doc_id, page, CASE WHEN idx % 4 = 0 THEN concat(CAST(conf AS STRING), '.', CAST(y AS STRING), ' / ', CAST(x AS STRING)) ELSE text END AS text FROM blocks) SELECT doc_id, page, count(*) AS lines, count(*) FILTER ({DENSE}) AS dense FROM l GROUP BY 1, 2")
def table_row_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).selectExpr("doc_id", "page", "CASE WHEN idx % 4 = 0 THEN concat(CAST(conf AS STRING), '.', CAST(y AS STRING), ' / ', CAST(x AS STRING)) ELSE text END AS text")
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.count_if(T.dense_in_symbols(F.col("text"))).alias("dense"))
