"""Official notices: lines of documents, some of which take the form of a notice's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import notices as N

LINES = (
    "doc_id",
    "idx",
    """CASE (doc_id * 7 + idx * 5) % 29 WHEN 0 THEN concat('一、', line) WHEN 1 THEN concat(CAST(idx % 9 + 1 AS STRING), '. ', line) WHEN 2 THEN concat('关于', line) WHEN 3 THEN concat(line, '的通知') WHEN 4 THEN concat('共青团', '第', CAST(doc_id % 7 AS STRING), '信息学院委员会')
 WHEN 5 THEN concat('202', CAST(doc_id % 5 AS STRING), '年4月', CAST(idx % 28 + 1 AS STRING), '日') WHEN 6 THEN '抄送：各学院' WHEN 7 THEN concat('附件', CAST(idx % 3 + 1 AS STRING), '：', line) WHEN 8 THEN '“学习新精神 奋进”' WHEN 9 THEN '昆明大学第一学院团总支'
 WHEN 10 THEN concat('校团字〔2023〕', CAST(idx + 1 AS STRING), '号') WHEN 11 THEN '通报：各支部' WHEN 12 THEN '此页无正文' WHEN 13 THEN '2' WHEN 14 THEN concat('二，', line) WHEN 15 THEN concat('关于召开会议的', '报告') WHEN 16 THEN concat('印于 2022 年 3 月 ', CAST(idx % 9 + 1 AS STRING), ' 日，又 2023年1月1日') ELSE line END AS line""",
)


def notice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (idx, line)")
    return rows.selectExpr(*LINES)


_STRIP = r"regexp_replace(line, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g')"
_CTE = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents), made AS (SELECT {', '.join(LINES)} FROM raw), cut AS (SELECT doc_id, idx, {_STRIP} AS line FROM made),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, line FROM cut WHERE line <> '' AND NOT regexp_matches(line, '^[1-9]$')),
m AS (SELECT *, lead(line, 1) OVER o AS one, lead(line, 2) OVER o AS two, regexp_matches(line, '{N.SECTION}') AS s, regexp_matches(line, '{N.SUBSECTION}') AND NOT regexp_matches(line, '{N.SECTION}') AS u,
  CASE WHEN regexp_matches(line, '{N.COPIES}') THEN 'cc' WHEN contains(line, '通报') AND contains(line, '支部') THEN 'distribution' WHEN regexp_matches(line, '{N.DATE}') THEN 'date' END AS kind FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
e AS (SELECT *, max(CASE WHEN s THEN n END) OVER o AS sec, max(CASE WHEN NOT s AND NOT u AND regexp_matches(line, '{N.BODY_ENDS}') THEN n END) OVER o AS fin, max(CASE WHEN regexp_matches(line, '{N.ATTACHMENT}') THEN n END) OVER o AS att FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
f AS (SELECT * REPLACE (CASE WHEN coalesce(fin, 0) < sec THEN sec END AS sec) FROM e),
g AS (SELECT *, max(CASE WHEN u AND sec IS NOT NULL THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS lastsub FROM f),
lines AS (SELECT *, CASE WHEN lastsub > sec THEN lastsub END AS sub, CASE WHEN sec IS NULL THEN NULL WHEN s THEN 'section' WHEN u THEN 'subsection' ELSE 'content' END AS role FROM g)"""


@query("notice_sections", f"""WITH {_CTE} SELECT doc_id, CAST(sec AS INT) AS section, CAST(sub AS INT) AS subsection, max(line) FILTER (n = coalesce(sub, sec)) AS heading, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (role = 'content'), '') AS content FROM lines WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def notice_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sections(N.marked(notice_lines(spark, sf_dir)))


@query("notice_attachments", f"""WITH {_CTE} SELECT doc_id, CAST(att AS INT) AS attachment, max(line) FILTER (n = att) AS name, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n <> att AND NOT regexp_matches(line, '{N.SIGNATURE}')), '') AS content FROM lines WHERE att IS NOT NULL GROUP BY 1, 2""")
def notice_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.attached(N.marked(notice_lines(spark, sf_dir)))


@query("notice_summary", f"""WITH {_CTE},
org AS (SELECT a.doc_id, a.n, max(b.n) AS bn FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n - 5 AND a.n - 1 WHERE regexp_matches(a.line, '{N.DATE}') AND regexp_matches(b.line, '{N.ORGANISATION}') AND length(b.line) > 4 GROUP BY 1, 2),
sig AS (SELECT org.doc_id, arg_min(b.line, org.n) AS organisation FROM org JOIN lines b ON b.doc_id = org.doc_id AND b.n = org.bn WHERE b.kind IS NULL GROUP BY 1),
t AS (SELECT *, CASE WHEN regexp_matches(line, '{N.TITLE}') THEN line WHEN regexp_matches(line || one, '{N.TITLE}') THEN line || one WHEN regexp_matches(line || one || two, '{N.TITLE}') THEN line || one || two END AS title FROM lines),
b AS (SELECT doc_id, arg_min(title, n) FILTER (title IS NOT NULL) AS title, arg_min(title = line, n) FILTER (title IS NOT NULL) AS whole, arg_min(coalesce(one, ''), n) FILTER (title IS NOT NULL) AS one, arg_min(coalesce(two, ''), n) FILTER (title IS NOT NULL) AS two, bool_or(regexp_matches(line, '[“”]')) AS quoted FROM t GROUP BY 1),
a AS (SELECT doc_id, arg_min(regexp_extract(line, '{N.HEADER}', 1), n) FILTER (regexp_matches(line, '{N.HEADER}')) AS header, arg_min(regexp_extract(line, '{N.REFERENCE}', 1), n) FILTER (regexp_matches(line, '{N.REFERENCE}')) AS ref_number,
  coalesce(arg_min(line, n) FILTER (kind = 'date'), arg_max(list_last(regexp_extract_all(line, '{N.LAST_DATE}')), n) FILTER (regexp_matches(line, '{N.LAST_DATE}'))) AS date, coalesce(string_agg(line, '|' ORDER BY n) FILTER (kind = 'cc'), '') AS copies, arg_max(line, n) FILTER (kind = 'distribution') AS distribution, count(*) FILTER (role = 'section') AS sections, count(*) FILTER (n = att) AS attachments FROM lines GROUP BY 1)
SELECT doc_id, header, ref_number, title, CASE WHEN quoted AND whole THEN CASE WHEN regexp_matches(one, '{N.LEAD_IN}') THEN one WHEN regexp_matches(two, '{N.LEAD_IN_NEXT}') THEN one || ' ' || two END END AS subtitle, organisation, date, copies, distribution, sections, attachments FROM a JOIN b USING (doc_id) LEFT JOIN sig USING (doc_id)""")
def notice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.summaries(N.marked(notice_lines(spark, sf_dir))).withColumn("copies", F.array_join("copies", "|"))
