"""Report lines and small reshapings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import report as R
from ..sources import ingest
from .derived import BLOCKS_CTE, blocks
from .extraction import CTE as PAPERS_CTE
from .extraction import KEY, papers
from .fees import PARSED_CTE
from .structure import LEVEL

NAMES = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.NAMES.items()) + " ELSE '其他证据' END"


@query("titles_and_purposes", f"""WITH {PAPERS_CTE}, t AS (SELECT *, CASE material_id % 4 WHEN 0 THEN '标题' WHEN 1 THEN filename END AS found, CASE WHEN material_id % 3 = 0 THEN '张三' ELSE '' END AS patient FROM papers)
SELECT material_id, CASE WHEN coalesce(found, '') <> '' AND found <> filename THEN found WHEN patient <> '' THEN concat(patient, ' - ', {NAMES}, '（', filename, '）') ELSE concat({NAMES}, '（', filename, '）') END AS title,
 CASE category WHEN 'identity_defendant' THEN '证明被告的主体资格及医疗机构执业信息' WHEN 'medical_record' THEN concat('证明', CASE WHEN patient <> '' THEN patient ELSE '患者' END, '的诊疗经过及损害后果') WHEN 'appraisal' THEN '证明医疗过错、因果关系及过错参与度' WHEN 'death_certificate' THEN '证明患者死亡的事实' ELSE '证明案件相关事实' END AS purpose FROM t""")
def titles_and_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("material_id")
    found = F.when(m % 4 == 0, "标题").when(m % 4 == 1, F.col("filename"))
    patient = F.when(m % 3 == 0, "张三").otherwise("")
    return papers(spark, sf_dir).select("material_id", R.title(F.col("category"), F.col("filename"), found, patient).alias("title"), R.purpose(F.col("category"), patient, F.lit(None).cast("double"), F.lit(False)).alias("purpose"))


@query("fee_summary_text", f"""WITH {PARSED_CTE}, k AS (SELECT case_id, material_id, concat(fee_type, ' ', printf('%.2f', CAST(amount AS DOUBLE)), '元') AS t, amount, row_number() OVER (PARTITION BY case_id ORDER BY material_id, concat(fee_type, ' ', printf('%.2f', CAST(amount AS DOUBLE)), '元')) AS k FROM parsed)
SELECT case_id, concat(string_agg(t, '；' ORDER BY k) FILTER (k <= 5), CASE WHEN count(*) > 5 THEN concat(' 等共', CAST(count(*) AS STRING), '项') ELSE '' END, '，合计：', printf('%.2f', CAST(sum(amount) AS DOUBLE)), '元') AS summary FROM k GROUP BY 1""")
def fee_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fees
    from .derived import receipts

    return R.fee_text(fees.parsed_receipts(receipts(spark, sf_dir)).withColumnRenamed("material_id", "seq"))


FEE_PAPERS = (f"{KEY} AS material_id", "CASE l_partkey % 6 WHEN 0 THEN '护理用品' WHEN 1 THEN '医保结算单' WHEN 2 THEN '住院一日清单' WHEN 3 THEN '材料清单' ELSE '票' END AS title", "CASE l_suppkey % 3 WHEN 0 THEN '门诊费用1.jpg' WHEN 1 THEN '打车.pdf' ELSE 'x.pdf' END AS filename", "CASE l_linenumber % 2 WHEN 0 THEN '中山人民医院 收费' ELSE '费用' END AS ocr_text")


@query("medical_fee_filter", f"WITH f AS (SELECT {', '.join(FEE_PAPERS)} FROM lineitem) SELECT material_id, CASE WHEN title = '护理用品' OR filename = '打车.pdf' THEN false WHEN filename = '门诊费用1.jpg' THEN true WHEN title IN ('医保结算单', '住院一日清单') THEN true WHEN title = '材料清单' THEN false ELSE contains(ocr_text, '人民医院') END AS medical FROM f")
def medical_fee_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*FEE_PAPERS)
    return rows.select("material_id", R.is_medical_fee(F.col("title"), F.col("filename"), F.col("ocr_text")).alias("medical"))


@query("filename_relations", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '张三' WHEN 1 THEN '李四' END AS name, CASE c_custkey % 4 WHEN 0 THEN '父亲' WHEN 1 THEN '母亲' WHEN 2 THEN '女儿' END AS relation FROM customer")
def filename_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '父亲张三身份证.jpg' WHEN 1 THEN '李四（母亲）.pdf' WHEN 2 THEN '女儿.pdf' ELSE 'scan.pdf' END AS f")
    return rows.select("c_custkey", R.from_filename(F.col("f")).alias("r")).select("c_custkey", "r.*")


@query("heading_reattach", f"""WITH {BLOCKS_CTE}, l AS (SELECT *, {LEVEL} AS level, CASE WHEN idx % 2 = 0 THEN substr(line, 1, 1) ELSE substr(line, 1, 2) END AS key FROM blocks), h AS (SELECT doc_id, trim(key) AS t, arg_max(level, idx) AS l FROM l WHERE level IS NOT NULL GROUP BY 1, 2)
SELECT l.doc_id, l.idx, CAST(coalesce(CASE WHEN l.idx % 3 = 0 THEN level END, h.l) AS INT) AS level FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.t = trim(l.key)""")
def heading_reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("level", T.heading_pattern_level(F.col("text"))).withColumn("text", F.expr("CASE WHEN idx % 2 = 0 THEN substr(line, 1, 1) ELSE substr(line, 1, 2) END"))
    known = rows.withColumn("level", F.when(F.col("idx") % 3 == 0, F.col("level")))
    return R.reattached(known, rows).select("doc_id", "idx", "level")


@query("confirmed_plaintiffs", f"""WITH p AS (SELECT CAST(l_orderkey AS BIGINT) AS case_id, {KEY} AS seq, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('1101011990010112', CAST(l_suppkey % 90 + 10 AS STRING)) END AS id_number FROM lineitem), t AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS case_id, concat('1101011990010112', CAST(l_suppkey % 45 + 10 AS STRING)) AS id_number FROM lineitem)
SELECT case_id, seq FROM p WHERE coalesce(id_number, '') = '' OR EXISTS (SELECT 1 FROM t WHERE t.case_id = p.case_id AND t.id_number = p.id_number)""")
def confirmed_plaintiffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    people = lines.selectExpr("CAST(l_orderkey AS BIGINT) AS case_id", f"{KEY} AS seq", "CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('1101011990010112', CAST(l_suppkey % 90 + 10 AS STRING)) END AS id_number")
    texts = lines.selectExpr("CAST(l_orderkey AS BIGINT) AS case_id", "concat('号码 1101011990010112', CAST(l_suppkey % 45 + 10 AS STRING), ' 完') AS ocr_text")
    return R.confirmed(people, texts).select("case_id", "seq")


@query("stage_shares", "SELECT event_type AS stage, CAST(sum(ms) AS BIGINT) AS total, round(sum(ms) * 100 / CAST(sum(sum(ms)) OVER () AS DOUBLE), 2) AS share FROM (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS ms FROM events) GROUP BY 1")
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type AS stage", "CAST(floor(value * 100) AS BIGINT) AS ms")
    return R.shares(rows, "stage", "ms")


@query("lowest_lines", f"WITH {BLOCKS_CTE} SELECT doc_id, idx, conf, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf, idx) AS k FROM blocks) WHERE k <= 5")
def lowest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lowest(blocks(spark, sf_dir)).select("doc_id", "idx", "conf", "place")


@query("group_headings", f"WITH {PAPERS_CTE}, g AS (SELECT DISTINCT case_id, category FROM papers) SELECT case_id, category, ['一', '二', '三', '四', '五', '六'][row_number() OVER (PARTITION BY case_id ORDER BY category)] AS heading FROM g")
def group_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = papers(spark, sf_dir).select("case_id", "category").distinct().withColumn("rank", F.col("category"))
    return R.numbered_groups(groups).select("case_id", "category", "heading")


@query("image_pages", f"WITH {PAPERS_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY case_id, category ORDER BY material_id) - 1 AS k, CASE WHEN starts_with(category, 'identity') THEN 4 ELSE 1 END AS per FROM papers) SELECT material_id, CAST(k // per AS INT) AS page, CAST(k % per AS INT) AS slot FROM k")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.image_pages(papers(spark, sf_dir)).select("material_id", "page", "slot")


@query("key_phrases", r"WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[，。；,.;\n]') AS a FROM documents), e AS (SELECT doc_id, regexp_replace(unnest(a), '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g') AS phrase, generate_subscripts(a, 1) - 1 AS i FROM s) SELECT doc_id, phrase, CAST(min(i) AS INT) AS place FROM e WHERE length(phrase) BETWEEN 3 AND 80 GROUP BY 1, 2")
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


CHANGES = ("user_id AS task_id", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'retrying' ELSE event_type END AS status")


@query("task_states", "SELECT user_id AS task_id, arg_max(CASE event_type WHEN 'error' THEN 'retrying' ELSE event_type END, event_id) AS status, count(*) FILTER (event_type = 'error') AS retries, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, max(event_id) FILTER (event_type = 'error') AS last_retry FROM events GROUP BY 1")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).selectExpr(*CHANGES, "at")
    return R.states(rows)


@query("step_durations", "SELECT event_id, CAST(floor(epoch_ms(ts + to_milliseconds(CAST(floor(value * 10) AS BIGINT))) - epoch_ms(ts)) AS BIGINT) AS duration_ms FROM events")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("start", F.col("ts").cast("timestamp"))
    end = F.timestamp_millis(F.unix_millis("start") + F.floor(F.col("value") * 10))
    return rows.select("event_id", (F.unix_millis(end) - F.unix_millis("start")).alias("duration_ms"))


@query("consecutive_numbers", "WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS number FROM lineitem) SELECT doc_id, count(*) >= 2 AND max(number) - min(number) + 1 = count(*) AS consecutive FROM d GROUP BY 1")
def consecutive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number")).distinct()
    return R.consecutive(rows)


@query("circled_run", f"""WITH i AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, {KEY} AS pos, l_linenumber AS number FROM lineitem), p AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM i), s AS (SELECT *, sum(CASE WHEN number <= b AND b >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM p) SELECT doc_id, pos, number FROM s WHERE s = 0""")
def circled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.circled_run(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_orderkey AS BIGINT) AS doc_id", f"{KEY} AS pos", "l_linenumber AS number"))


@query("page_bounds", f"WITH {BLOCKS_CTE} SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM blocks GROUP BY 1, 2")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).selectExpr("doc_id", "page", "array(named_struct('x', x, 'y', y), named_struct('x', x + w, 'y', y), named_struct('x', x + w, 'y', y + h), named_struct('x', x, 'y', y + h)) AS points")
    return R.bounds(rows, ["doc_id", "page"])


@query("file_kinds", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'docx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'audio' ELSE 'other' END AS kind, CASE c_custkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' END AS magic FROM customer")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "CASE c_custkey % 6 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.docx' WHEN 3 THEN 'd.xls' WHEN 4 THEN 'e.mp3' ELSE 'f' END AS f", "CASE c_custkey % 3 WHEN 0 THEN unhex('255044462D31') WHEN 1 THEN unhex('89504E470D') ELSE unhex('00') END AS content")
    return rows.select("c_custkey", ingest.file_kind(F.col("f")).alias("kind"), ingest.magic_kind(F.col("content")).alias("magic"))


@query("content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("notice_fields", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'notice' WHEN 1 THEN 'decision' ELSE 'other' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN concat('卫发〔2023〕', CAST(c_custkey AS STRING), '号') END AS number, '某市卫生局' AS organisation, CASE WHEN c_custkey % 5 <> 0 THEN '2023年2月3日' ELSE '2022年1月1日' END AS date FROM customer")
def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "concat('某市卫生局', chr(10), CASE c_custkey % 3 WHEN 0 THEN '通知' WHEN 1 THEN '决定' ELSE '函' END, chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('卫发〔2023〕', CAST(c_custkey AS STRING), '号') ELSE '' END, chr(10), '2022年1月1日', CASE WHEN c_custkey % 5 <> 0 THEN '至2023年2月3日' ELSE '' END) AS t")
    return rows.select("c_custkey", R.notice_fields(F.col("t")).alias("n")).select("c_custkey", "n.*")


@query("three_way_partition", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'skipped' ELSE 'accepted' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def three_way_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    outcome = F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 3 == 0, "skipped").otherwise("accepted")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("name_sets", "(SELECT 'only_small' AS side, p_name AS name FROM (SELECT p_name FROM part WHERE p_size < 5 EXCEPT SELECT p_name FROM part WHERE p_size > 47)) UNION ALL (SELECT 'both', p_name FROM (SELECT p_name FROM part WHERE p_size < 5 INTERSECT SELECT p_name FROM part WHERE p_size > 47))")
def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet")
    small, large = names.where("p_size < 5").select(F.col("p_name").alias("name")), names.where("p_size > 47").select(F.col("p_name").alias("name"))
    return small.exceptAll(small.intersect(large)).distinct().join(large, "name", "left_anti").select(F.lit("only_small").alias("side"), "name").unionByName(small.intersect(large).select(F.lit("both").alias("side"), "name"))


@query("upsert_tasks", """WITH c AS (SELECT c_custkey AS id, c_name AS name FROM customer), ch AS (SELECT o_custkey + 100 AS id, concat('new', CAST(o_orderkey AS STRING)) AS name, o_orderkey AS seq FROM orders), l AS (SELECT id, arg_max(name, seq) AS name FROM ch GROUP BY 1)
SELECT id, name FROM l UNION ALL SELECT id, name FROM c WHERE id NOT IN (SELECT id FROM l)""")
def upsert_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import upserted

    current = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name")
    changes = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey + 100 AS id", "concat('new', CAST(o_orderkey AS STRING)) AS name", "o_orderkey AS seq")
    return upserted(current, changes, ["id"], "seq")
