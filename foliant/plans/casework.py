"""Materials: classification, extraction, merging, catalog, requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import casework as C
from ..operators import slot
from ..session import stored

MATERIALS = (
    "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS material_id",
    "CAST(l_orderkey AS BIGINT) AS case_id",
    "CASE l_orderkey % 3 WHEN 0 THEN 'death' ELSE 'injury' END AS case_type",
    "CAST(l_shipdate AS TIMESTAMP) AS created_at",
    "CASE l_linenumber % 6 WHEN 0 THEN '身份证正面.jpg' WHEN 1 THEN '户口本.pdf' WHEN 2 THEN '死亡证明.pdf' WHEN 3 THEN '出院小结.pdf' WHEN 4 THEN '司法鉴定.pdf' ELSE 'scan.pdf' END AS filename",
    "CASE l_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '居民身份证 签发机关 公民身份号码 110101199001011234' WHEN 2 THEN concat('姓名：张三丰', chr(10), '死亡证明 死亡诊断：多器官功能衰竭综合征。', chr(10), '身份证号：11010119900101123X') WHEN 3 THEN concat('北京市第', CAST(l_suppkey % 20 AS STRING), '人民医院出院记录', chr(10), '患者：李四', chr(10), '入院日期：2023-01-0', CAST(l_linenumber AS STRING), chr(10), '出院诊断：急性阑尾炎术后恢复期') WHEN 4 THEN '司法鉴定意见书 因果关系 参与度 伤残等级' WHEN 5 THEN concat('门诊发票 合计：', CAST(l_linenumber * 100 AS STRING), ' 检查费：50.5 CT报告') WHEN 6 THEN '无关文字' WHEN 7 THEN '营业执照 统一社会信用代码：91110000100000000X' ELSE '  ' END AS ocr_text",
)
CTE = f"materials AS (SELECT {', '.join(MATERIALS)} FROM lineitem)"


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*MATERIALS)


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower(ocr_text), '{w}') AS INT)" for w in words)


SCORES = " UNION ALL ".join(f"SELECT material_id, '{c}' AS category, {C.PRIORITY[c]} AS priority, {_hits(w)} AS hits FROM materials" + (" WHERE case_type = 'death'" if c in C.DEATH_ONLY else "") for c, w in C.KEYWORDS.items())
NAME = "CASE " + " ".join(f"WHEN regexp_matches(lower(filename), '{'|'.join(w)}')" + (" AND case_type = 'death'" if c in C.DEATH_ONLY else "") + f" THEN '{c}'" for w, c in C.FILENAMES) + " END"
CLASSIFIED = f"""{CTE}, scores AS ({SCORES}), best AS (SELECT material_id, arg_max(category, hits * 1000 + priority) AS category, max(hits) AS hits FROM scores WHERE hits > 0 GROUP BY 1),
j AS (SELECT m.*, b.category AS tc, CASE WHEN trim(ocr_text) = '' THEN 0 WHEN b.hits IS NULL THEN 0.3 ELSE least(0.95, round(0.6 + b.hits * 0.05, 2)) END AS c, {NAME} AS n FROM materials m LEFT JOIN best b USING (material_id)),
k AS (SELECT *, CASE WHEN filename = '' THEN 0 WHEN n IS NOT NULL THEN 0.5 ELSE 0.1 END AS nc FROM j),
classified AS (SELECT material_id, case_id, case_type, created_at, CASE WHEN c < 0.5 AND nc > c THEN coalesce(n, 'other_evidence') ELSE coalesce(tc, 'other_evidence') END AS category, CAST(CASE WHEN c < 0.5 AND nc > c THEN nc ELSE c END AS DOUBLE) AS confidence FROM k)"""


@query("keyword_score_classify", f"WITH {CLASSIFIED} SELECT material_id, category, confidence FROM classified")
def keyword_score_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classified(materials(spark, sf_dir)).select("material_id", "category", "confidence")


@query("effective_category", f"WITH {CLASSIFIED} SELECT material_id, coalesce(nullif(CASE material_id % 10 WHEN 1 THEN 'appraisal' WHEN 2 THEN '' END, ''), category) AS category FROM classified")
def effective_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = F.when(F.col("material_id") % 10 == 1, "appraisal").when(F.col("material_id") % 10 == 2, "")
    rows = C.classified(materials(spark, sf_dir))
    return rows.select("material_id", F.coalesce(F.nullif(manual, F.lit("")), "category").alias("category"))


DOC_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(ocr_text), '{'|'.join(w)}') THEN '{k}'" for w, k in C.DOC_TYPES) + " ELSE 'other' END"


@query("doc_type_ladder", f"WITH {CTE} SELECT material_id, {DOC_TYPE} AS doc_type FROM materials")
def doc_type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials(spark, sf_dir).select("material_id", C.doc_type(F.col("ocr_text")).alias("doc_type"))


@query("paragraph_importance", f"WITH {CTE} SELECT material_id, CAST(CASE WHEN regexp_matches(ocr_text, '{C.CRITICAL}') THEN 0 WHEN regexp_matches(ocr_text, '{C.IMPORTANT}') THEN 1 ELSE 2 END AS INT) AS importance FROM materials")
def paragraph_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials(spark, sf_dir).select("material_id", C.importance(F.col("ocr_text")).alias("importance"))


FIELDS = ", ".join(f"trim(nullif(regexp_extract(ocr_text, '{p}', {g}), '')) AS {k}" for k, (p, g, _) in {**C.IDENTITY, **C.TREATMENT}.items())


@query("rule_extraction", f"WITH {CTE} SELECT material_id, left(string_split(trim(ocr_text), chr(10))[1], 100) AS title, {DOC_TYPE} AS doc_type, {FIELDS} FROM materials")
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials(spark, sf_dir).select("material_id", C.extracted(F.col("ocr_text")).alias("e")).select("material_id", "e.*")


@query("layer_merge_coalesce", f"""WITH {CTE}, e AS (SELECT material_id, {FIELDS} FROM materials)
SELECT material_id, coalesce(nullif(CASE material_id % 4 WHEN 0 THEN 'model' WHEN 1 THEN '' END, ''), patient_name) AS patient_name, coalesce(nullif(CASE material_id % 3 WHEN 0 THEN 'D' END, ''), diagnosis) AS diagnosis, CAST(coalesce(nullif(CASE WHEN material_id % 2 = 0 THEN 0 ELSE 12 END, 0), nullif(7, 0), 0) AS DOUBLE) AS total_amount FROM e""")
def layer_merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("material_id")
    rows = materials(spark, sf_dir).select("material_id", C.extracted(F.col("ocr_text")).alias("e"))
    rule = {"patient_name": F.col("e.patient_name"), "diagnosis": F.col("e.diagnosis"), "total_amount": F.when(m % 2 == 0, 0.0).otherwise(12.0)}
    model = {"patient_name": F.when(m % 4 == 0, "model").when(m % 4 == 1, ""), "diagnosis": F.when(m % 3 == 0, "D"), "total_amount": F.lit(7.0)}
    return rows.select("material_id", *[v.alias(k) for k, v in C.merged(rule, model).items()])


@query("coverage_ratio", f"""WITH {CTE}, e AS (SELECT material_id, {FIELDS}, CASE WHEN contains(ocr_text, '费：') THEN 1 ELSE 0 END AS n, CASE WHEN contains(ocr_text, '合计') THEN 5 ELSE 0 END AS t FROM materials)
SELECT material_id, (CAST(coalesce(patient_name <> '', false) AS INT) + CAST(coalesce(patient_id <> '', false) AS INT) + CAST(coalesce(diagnosis <> '', false) AS INT) + n + CAST(t <> 0 AS INT)) / (3 + n + 1) AS coverage FROM e""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materials(spark, sf_dir).select("material_id", "ocr_text", C.extracted(F.col("ocr_text")).alias("e"))
    n = F.when(F.col("ocr_text").contains("费："), 1).otherwise(0)
    t = F.when(F.col("ocr_text").contains("合计"), 5).otherwise(0)
    return rows.select("material_id", C.coverage([F.col("e.patient_name"), F.col("e.patient_id"), F.col("e.diagnosis")], n, t).alias("coverage"))


RANK = "coalesce(list_position([" + ", ".join(f"'{c}'" for c in C.ORDER) + "], category), 10)"


@query("catalog_numbering", f"WITH {CLASSIFIED} SELECT material_id, category, CAST(row_number() OVER (PARTITION BY case_id ORDER BY {RANK}, created_at, material_id) AS INT) AS catalog_index, CAST(row_number() OVER (PARTITION BY case_id, category ORDER BY created_at, material_id) AS INT) AS group_index FROM classified")
def catalog_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog(C.classified(materials(spark, sf_dir))).select("material_id", "category", "catalog_index", "group_index")


@query("page_ranges_cumsum", f"""WITH {CLASSIFIED}, g AS (SELECT case_id, category, count(*) AS n_items FROM classified GROUP BY 1, 2), p AS (SELECT *, CAST(CASE WHEN starts_with(category, 'identity') THEN ceil(n_items / 4) WHEN category IN ('medical_record', 'appraisal', 'death_certificate') THEN n_items ELSE ceil(n_items / 3) END AS BIGINT) AS pages FROM g),
s AS (SELECT *, CAST(sum(pages) OVER (PARTITION BY case_id ORDER BY {RANK}, category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page_end FROM p) SELECT case_id, category, n_items, pages, page_end - pages + 1 AS page_start, page_end FROM s""")
def page_ranges_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = C.classified(materials(spark, sf_dir)).groupBy("case_id", "category").agg(F.count("*").alias("n_items"))
    return C.page_ranges(groups)


REQUIREMENTS = (("injury", "identity_id_card", True), ("injury", "identity_hukou", False), ("injury", "medical_record", True), ("injury", "fee_receipt", True), ("death", "identity_id_card", True), ("death", "death_certificate", True), ("death", "medical_record", True))
REQUIREMENTS_SQL = ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in REQUIREMENTS)


@query("requirement_coverage", f"""WITH {CLASSIFIED}, r(case_type, category, is_required) AS (VALUES {REQUIREMENTS_SQL}), cs AS (SELECT DISTINCT case_id, case_type FROM materials), pr AS (SELECT DISTINCT case_id, category FROM classified)
SELECT cs.case_id, r.category, r.is_required, pr.case_id IS NOT NULL AS has_evidence, CASE WHEN pr.case_id IS NOT NULL OR NOT r.is_required THEN 'ok' ELSE 'missing' END AS status FROM cs JOIN r USING (case_type) LEFT JOIN pr ON pr.case_id = cs.case_id AND pr.category = r.category""")
def requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.classified(materials(spark, sf_dir))
    required = spark.createDataFrame(list(REQUIREMENTS), "case_type string, category string, is_required boolean")
    return C.requirement_coverage(required, rows.select("case_id", "case_type").distinct(), rows)


CARDS = ("CAST(l_orderkey AS BIGINT) AS case_id", "concat('n', CAST(l_suppkey % 7 AS STRING)) AS name", "CASE WHEN l_linenumber % 2 = 0 THEN 'front' ELSE 'back' END AS side", "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS material_id", "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS seq")


@query("front_back_pairing", f"WITH c AS (SELECT {', '.join(CARDS)} FROM lineitem), f AS (SELECT case_id, name, arg_max(material_id, seq) AS front FROM c WHERE side = 'front' GROUP BY 1, 2), b AS (SELECT case_id, name, arg_max(material_id, seq) AS back FROM c WHERE side = 'back' GROUP BY 1, 2) SELECT case_id, name, front, back FROM f FULL JOIN b USING (case_id, name)")
def front_back_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*CARDS))


PHRASES = "phrases AS (SELECT doc_id, unnest([substr(text, 5, 6), substr(text, 40, 5), substr(text, 200, 6)]) AS phrase FROM documents), ph AS (SELECT DISTINCT doc_id, phrase FROM phrases WHERE length(phrase) >= 3)"


def _phrases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.selectExpr("doc_id", "explode(array(substr(text, 5, 6), substr(text, 40, 5), substr(text, 200, 6))) AS phrase").where("length(phrase) >= 3").distinct()
    return docs, found


@query("phrase_page_match", f"""WITH {PHRASES}, pg AS (SELECT doc_id, CAST(unnest(generate_series(0, CAST((length(text) - 1) // 100 AS BIGINT))) AS INT) AS page, text FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, page, substr(text, page * 100 + 1, 100) AS t FROM pg)
SELECT p.doc_id, p.page, count(*) AS n_phrases FROM p JOIN ph ON ph.doc_id = p.doc_id AND contains(p.t, ph.phrase) GROUP BY 1, 2 HAVING count(*) >= 2""")
def phrase_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _phrases(spark, sf_dir)
    pages = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,100}"), F.lit(0))).alias("page", "text"))
    return C.phrase_pages(pages, found)


@query("position_page_estimate", f"""WITH {PHRASES}, t AS (SELECT doc_id, text, CAST(1 + length(text) // 500 AS INT) AS pages FROM documents), f AS (SELECT t.doc_id, pages, CAST(floor((instr(text, phrase) - 1) / greatest(length(text) / greatest(pages, 1), 100)) AS INT) AS p FROM t JOIN ph USING (doc_id) WHERE instr(text, phrase) > 0),
a AS (SELECT doc_id, pages, unnest([p - 1, p, p + 1]) AS page FROM f) SELECT DISTINCT doc_id, page FROM a WHERE page >= 0 AND page < pages""")
def position_page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _phrases(spark, sf_dir)
    return C.estimated_pages(docs.selectExpr("doc_id", "text", "CAST(1 + length(text) div 500 AS INT) AS pages"), found)


@query("most_frequent_name", f"""WITH {CTE}, n AS (SELECT case_id, material_id AS seq, trim(nullif(regexp_extract(ocr_text, '([^\n，。；]{{2,20}}(医院|卫生院|诊所|卫生所|社区卫生服务中心))', 1), '')) AS name FROM materials), c AS (SELECT case_id, name, count(*) AS n, min(seq) AS s FROM n WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT case_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, s) AS k FROM c) WHERE k = 1""")
def most_frequent_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materials(spark, sf_dir).select("case_id", F.col("material_id").alias("seq"), C.extracted(F.col("ocr_text"))["hospital_name"].alias("name")).where("name is not null")
    return C.most_frequent(rows, ["case_id"])


@query("proof_purpose_listagg", f"WITH {CLASSIFIED}, p AS (SELECT case_id, category, CASE material_id % 5 WHEN 0 THEN '' WHEN 1 THEN '证明主体' WHEN 2 THEN '证明诊疗' ELSE '证明损失' END AS purpose FROM classified) SELECT case_id, category, string_agg(purpose, '；' ORDER BY purpose) AS purposes FROM (SELECT DISTINCT * FROM p WHERE purpose <> '') GROUP BY 1, 2")
def proof_purpose_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.classified(materials(spark, sf_dir)).selectExpr("case_id", "category", "CASE material_id % 5 WHEN 0 THEN '' WHEN 1 THEN '证明主体' WHEN 2 THEN '证明诊疗' ELSE '证明损失' END AS purpose")
    return C.purposes(rows)


def _packed(limit: int, levels: int = 3) -> str:
    """The fold in SQL, a level after the other: what fits up to the first that does not, of which a start over 50 characters is taken."""
    out = [f"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
mk AS (SELECT doc_id, idx, CASE WHEN idx % 5 = 3 THEN '诊断 ' || line WHEN idx % 7 = 4 THEN '死亡诊断 ' || line ELSE line END AS t FROM ls),
p AS (SELECT doc_id, idx, length(t) AS n, CASE WHEN regexp_matches(t, '{C.CRITICAL}') THEN 0 WHEN regexp_matches(t, '{C.IMPORTANT}') THEN 1 ELSE 2 END AS lv FROM mk),
a0 AS (SELECT DISTINCT doc_id, 0 AS used FROM p)"""]
    for k in range(levels):
        out.append(f"""c{k} AS (SELECT p.doc_id, idx, n, used + sum(n) OVER (PARTITION BY p.doc_id ORDER BY idx) AS c FROM p JOIN a{k} USING (doc_id) WHERE lv = {k}),
u{k} AS (SELECT a{k}.doc_id, coalesce(max(c) FILTER (c <= {limit}), any_value(used)) AS used, min(idx) FILTER (c > {limit}) AS cut FROM a{k} LEFT JOIN c{k} USING (doc_id) GROUP BY 1),
a{k + 1} AS (SELECT doc_id, CASE WHEN cut IS NOT NULL AND {limit} - used > 50 THEN {limit} ELSE used END AS used FROM u{k}),
r{k} AS (SELECT doc_id, {k} AS lv, idx, n FROM c{k} WHERE c <= {limit} UNION ALL SELECT doc_id, {k}, cut, {limit} - used FROM u{k} WHERE cut IS NOT NULL AND {limit} - used > 50)""")
    rows = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(levels))
    return f"WITH {', '.join(out)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lv, idx) - 1 AS INT) AS place, CAST(idx AS INT) AS idx, CAST(n AS INT) AS n_chars FROM ({rows})"


@query("context_pack", _packed(2000))
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    marked = docs.withColumn("text", F.when(F.col("idx") % 5 == 3, F.concat(F.lit("诊断 "), "text")).when(F.col("idx") % 7 == 4, F.concat(F.lit("死亡诊断 "), "text")).otherwise(F.col("text")))
    return C.packed_context(marked, 2000)


@query("mask_id", "SELECT c_custkey, CASE WHEN length(t) < 10 THEN t ELSE concat(left(t, 6), '****', right(t, 4)) END AS masked FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE c_name END AS t FROM customer)")
def mask_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE c_name END AS t")
    return rows.select("c_custkey", T.masked_id(F.col("t")).alias("masked"))


@query("html_strip_clean", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_strip_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("digest"))


@query("json_field_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.missing'), '[待补充]') AS missing FROM events")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int, missing string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit("[待补充]")).alias("missing"))


@query("chunk_6000", "SELECT doc_id, CAST(c AS INT) AS chunk, length(substr(text, CAST(c * 6000 + 1 AS BIGINT), 6000)) AS n, md5(substr(text, CAST(c * 6000 + 1 AS BIGINT), 6000)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 6000)) AS c FROM documents WHERE length(text) > 0)")
def chunk_6000(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,6000}"), F.lit(0))).alias("chunk", "part")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", part)
    return rows.select("doc_id", "chunk", F.length("part").cast("long").alias("n"), F.md5("part").alias("digest"))


@query("batch_of_5", "SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS INT) AS batch FROM documents")
def batch_of_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batched(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "source", "doc_id")


@query("private_url_filter", """WITH u AS (SELECT c_custkey, concat(CAST(c_custkey % 256 AS STRING), '.', CAST(c_custkey % 200 AS STRING), '.0.', CAST(c_nationkey AS STRING)) AS host FROM customer), q AS (SELECT *, CAST(split_part(host, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(host, '.', 2) AS BIGINT) * 65536 + CAST(split_part(host, '.', 4) AS BIGINT) AS n FROM u)
SELECT c_custkey, host, n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 0 AND 16777215 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 3323068416 AND 3323199487 AS private FROM q""")
def private_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "concat(CAST(c_custkey % 256 AS STRING), '.', CAST(c_custkey % 200 AS STRING), '.0.', CAST(c_nationkey AS STRING)) AS host")
    return rows.select("c_custkey", "host", T.is_private_host(F.col("host")).alias("private"))


@query("receipt_tail", "SELECT c_custkey, CASE WHEN length(regexp_replace(f, '[^0-9]', '', 'g')) >= 4 THEN right(regexp_replace(f, '[^0-9]', '', 'g'), 4) ELSE '' END AS tail FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '.pdf') ELSE 'a12.jpg' END AS f FROM customer)")
def receipt_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '.pdf') ELSE 'a12.jpg' END AS f")
    return rows.select("c_custkey", T.receipt_tail(F.col("f")).alias("tail"))


def by_title() -> slot.Engine:
    """A stand-in for a model: the kind of document by the words of its ladder; it cannot answer for every eleventh material."""

    def engine(items: list[dict]) -> list[dict]:
        if any(i["material_id"] % 11 == 0 for i in items):
            raise RuntimeError("429")
        kinds = [next((kind for words, kind in C.DOC_TYPES if any(w in i["text"].lower() for w in words)), "other") for i in items]
        return [{"category": kind, "confidence": 0.8, "extracted": {"symptoms": f"s{i['material_id'] % 5}"}} for kind, i in zip(kinds, items)]

    return engine


_FEE = "list_filter(regexp_extract_all(ocr_text, '([\\x{4e00}-\\x{9fff}]+费)[：:\\s]*[¥￥]?([\\d,.]+)', 2), lambda a: TRY_CAST(replace(a, ',', '') AS DOUBLE) IS NOT NULL)"
_RELATED, _SYMPTOM, _TOTAL = r"'(法定代理人|监护人|亲属|近亲属)[：:\s]*([^\n，。]{2,10})'", r"'(主诉|症状|因)[：:\s]*([^\n。]{10,200})'", r"'(合计|总计|金额|费用合计)[：:\s]*[¥￥]?([\d,.]+)'"
_FOUND = "(" + " + ".join(f"CAST(coalesce({f}, '') <> '' AS INT)" for f in slot.FIELDS) + ")"


@query("model_slot", f"""WITH {CLASSIFIED}, m2 AS (SELECT m.material_id, m.case_type, ocr_text, trim(ocr_text) = '' AS blank, category, confidence, {DOC_TYPE} AS kind, {FIELDS},
 trim(nullif(regexp_extract(ocr_text, {_RELATED}, 2), '')) AS legal_representative, nullif(regexp_extract(ocr_text, {_RELATED}, 1), '') AS relationship, trim(nullif(regexp_extract(ocr_text, {_SYMPTOM}, 2), '')) AS symptoms,
 coalesce(TRY_CAST(replace(regexp_extract(ocr_text, {_TOTAL}, 2), ',', '') AS DOUBLE), 0) AS total_amount, len({_FEE}) AS items FROM materials m JOIN (SELECT DISTINCT material_id, category, confidence FROM classified) USING (material_id)),
c AS (SELECT *, (3 + {_FOUND} + items + CAST(total_amount <> 0 AS INT)) / (3 + {_FOUND} + items + 1) AS coverage FROM m2),
s AS (SELECT *, blank OR (confidence >= 0.6 AND coverage >= 0.4) AS sure, material_id % 11 <> 0 AS answers, list_contains([{", ".join(f"'{c}'" for c in C.ORDER)}], kind) AND (case_type = 'death' OR kind <> 'death_certificate') AS fits FROM c)
SELECT material_id, CASE WHEN blank THEN 'other_evidence' WHEN sure OR NOT answers THEN category WHEN fits THEN kind ELSE 'other_evidence' END AS category,
 CAST(CASE WHEN blank THEN 0.1 WHEN sure OR NOT answers THEN confidence WHEN fits THEN 0.8 ELSE 0.3 END AS DOUBLE) AS confidence, {", ".join(f for f in slot.FIELDS if f != "symptoms")},
 CASE WHEN sure OR NOT answers THEN symptoms ELSE concat('s', CAST(material_id % 5 AS STRING)) END AS symptoms, total_amount, CASE WHEN sure THEN 'rules' WHEN answers THEN 'model' ELSE 'rules, no answer' END AS answered_by FROM s""")
def model_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials by rules, and by a stand-in for a model where the rules are unsure; calls are left out, as they depend on who meets in a batch."""
    return slot.with_model(stored(slot.ruled(materials(spark, sf_dir)), "ruled"), by_title).drop("calls")
