"""Materials of a case: classification, extraction by rules, merging with a model's answers, catalog."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T
from ..functions.text import contains_any, first_group, stripped

# Fixed values, down to TREATMENT: words that speak for a category, categories in catalog order, precedence in a tie, words of
# file names and document types, words that make a paragraph critical or important, and the patterns of fields.
KEYWORDS = {
    "identity_id_card": ("居民身份证", "身份证正面", "身份证反面", "身份证人像", "身份证国徽", "签发机关", "有效期限", "公民身份号码"),
    "identity_hukou": ("户口本", "户口", "户籍", "常住人口登记", "户别", "户号", "户主姓名"),
    "identity_other": ("出生证明", "出生医学证明", "出生证", "亲子鉴定", "监护证明", "监护权", "收养证明", "领养证", "结婚证", "结婚", "婚姻", "离婚证"),
    "identity_defendant": ("营业执照", "执业许可证", "信用代码", "统一社会信用代码", "法定代表人", "事业单位", "医疗机构执业许可证", "医疗机构登记", "执业医师", "执业证", "资格证", "医师资格", "护士执业", "执业范围", "卫生专业技术", "注册信息", "医务人员资质", "医师执业证"),
    "death_certificate": ("死亡证明", "居民死亡", "死亡医学证明", "死亡诊断", "火化证明", "死亡推断", "死亡通知书"),
    "medical_record": ("病历", "出院记录", "入院记录", "手术记录", "检查报告", "门诊病历", "门诊", "住院", "病程", "医嘱", "护理记录", "手术同意书", "知情同意书", "ct报告", "mri报告", "b超报告", "化验单", "出院小结", "诊断证明", "死亡记录", "长期医嘱", "临时医嘱", "体温单"),
    "appraisal": ("司法鉴定", "鉴定意见书", "伤残等级", "因果关系", "参与度", "鉴定意见", "鉴定书", "过错认定", "过错参与度", "法医鉴定", "尸体检验", "尸检报告", "尸体解剖", "死因鉴定", "解剖报告", "病理鉴定", "毒物鉴定"),
    "fee_receipt": ("发票", "票据", "收费", "收据", "结算", "费用清单", "住院费用", "门诊费用", "医疗费", "药费", "挂号费", "检查费", "手术费", "床位费", "护理费", "收费票据", "费用明细", "收费项目"),
}
PRIORITY = {"death_certificate": 100, "appraisal": 90, "identity_other": 80, "identity_defendant": 70, "identity_hukou": 60, "identity_id_card": 50, "fee_receipt": 40, "medical_record": 30, "other_evidence": 10}
ORDER = ("identity_id_card", "identity_hukou", "identity_other", "identity_defendant", "death_certificate", "medical_record", "appraisal", "fee_receipt", "other_evidence")
DEATH_ONLY = ("death_certificate",)
FILENAMES = (
    (("身份证", "反面", "正面"), "identity_id_card"),
    (("户口本", "户口册", "户籍"), "identity_hukou"),
    (("结婚证", "出生证明", "出生证"), "identity_other"),
    (("被告", "营业执照", "信用代码"), "identity_defendant"),
    (("死亡证明", "死亡记录", "火化"), "death_certificate"),
    (("病历", "出院", "入院", "门诊病历", "手术", "检查报告"), "medical_record"),
    (("鉴定", "法医", "尸检"), "appraisal"),
    (("发票", "收据", "票据", "费用", "清单", "门诊费用", "住院清单", "住院费用", "医保结算", "医保报销", "日常用品", "护理用品", "生活用品", "护理品", "陪护用品", "医疗器械", "医用器械", "康复器械", "辅助器具", "护理器械", "轮椅", "拐杖", "助行器", "护理床", "医用耗材"), "fee_receipt"),
)
DOC_TYPES = (
    (("身份证", "居民身份"), "identity_id_card"),
    (("户口本", "户口", "户籍"), "identity_hukou"),
    (("出生证明", "出生医学证明"), "identity_other"),
    (("营业执照", "执业许可证", "信用代码", "统一社会信用代码"), "identity_defendant"),
    (("病历", "诊断", "出院", "入院", "手术"), "medical_record"),
    (("发票", "费用", "金额", "收费"), "fee_receipt"),
    (("鉴定", "伤残等级", "因果关系"), "appraisal"),
    (("死亡", "尸检", "火化"), "death_certificate"),
)
#: Levels of importance, and characters of a paragraph's start that are worth taking (fixed values).
LEVELS, START = 3, 50
CRITICAL = "死亡诊断|死因分析|死亡原因|鉴定意见|鉴定结论|尸检诊断|解剖诊断|病理诊断|尸检报告|手术记录|执业证|执业范围|身份证号|身份证号码|统一社会信用代码|执业医师|鉴定人|鉴定机构|死亡诊断意见|出院诊断|死亡证明|尸体检验|尸体解剖|死因鉴定|解剖报告|病理鉴定|毒物鉴定|居民身份|户口|户籍|户主|身份号码|出生日期|住址|姓名|性别|民族"
IMPORTANT = "诊断|治疗|检查|入院|出院|医嘱|护理|手术|转院|主诉|现病史|既往史|用药|处方|病程|抢救|ICU|检验|化验|CT|MRI|B超|血气|心电图|体温|血压|伤残等级|过错|因果关系|参与度|不良后果|并发症"
IDENTITY = {
    "patient_name": (r"(患者|病人|姓\s*名)[：:\s]*([^\n，。；]{2,10})", 2, ("患者", "病人", "名")),
    "patient_id": (r"(身份证号|证件号码|身份证)[：:\s]*([\dXx*]{15,18})", 2, ("身份证", "证件号码")),
    "hospital_name": (r"([^\n，。；]{2,20}(医院|卫生院|诊所|卫生所|社区卫生服务中心))", 1, ("医院", "卫生院", "诊所", "卫生所", "社区卫生服务中心")),
    "hospital_code": (r"(统一社会信用代码|信用代码)[：:\s]*([\dA-Z]{18})", 2, ("信用代码",)),
}
TREATMENT = {
    "diagnosis": (r"(诊断|入院诊断|出院诊断|主要诊断)[：:\s]*([^\n。]{5,200})", 2, ("诊断",)),
    "admission_date": (r"(入院日期|住院日期)[：:\s]*([\d-]{6,10})", 2, ("入院日期", "住院日期")),
    "discharge_date": (r"(出院日期)[：:\s]*([\d-]{6,10})", 2, ("出院日期",)),
}


@lru_cache(maxsize=1)
def keyword_automaton():
    """All words of all categories in one automaton; each leads to the categories that it speaks for."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for i, words in enumerate(KEYWORDS.values()):
        for w in words:
            found.setdefault(w, []).append(i)
    automaton = ahocorasick.Automaton()
    for w, categories in found.items():
        automaton.add_word(w, (w, tuple(categories)))
    automaton.make_automaton()
    return automaton


@F.arrow_udf(IntegerType())
def best_score(text: pa.Array, death: pa.Array) -> pa.Array:
    """1000 * different words + priority of the category with most words in a text (in lower case); null without any.

    One automaton finds all words in a single pass over a text, where an expression would pass over it once a word.
    """
    automaton, n = keyword_automaton(), len(KEYWORDS)
    priorities = [PRIORITY[c] for c in KEYWORDS]
    only_death = [c in DEATH_ONLY for c in KEYWORDS]
    out: list[int | None] = []
    for t, is_death in zip(text.to_pylist(), death.to_pylist()):
        words = {x for _, x in automaton.iter(t)}
        counts = [0] * n
        for _, categories in words:
            for i in categories:
                counts[i] += 1
        out.append(max((1000 * c + priorities[i] for i, c in enumerate(counts) if c and (is_death or not only_death[i])), default=None))
    return pa.array(out, pa.int32())


def classified(materials: DataFrame) -> DataFrame:
    """materials with category and confidence: by words of the text, by the file name if that says more.

    case_type 'death' opens the category of death certificates. A text with words counts 0.6 and 0.05 for
    each, 0.95 at most; one without 0.3, a blank one 0; a file name that fits a rule 0.5, one that fits none 0.1.
    """
    death = F.coalesce(F.col("case_type") == "death", F.lit(False))
    rows = materials.withColumn("_b", best_score(F.coalesce(F.lower("ocr_text"), F.lit("")), death))
    blank = F.coalesce(stripped(F.col("ocr_text")), F.lit("")) == ""
    words = F.floor(F.col("_b") / 1000)
    by_text = F.when(blank, 0.0).when(F.col("_b").isNull(), 0.3).otherwise(F.least(F.lit(0.95), F.round(0.6 + words * 0.05, 2)))
    name = F.lit(None).cast("string")
    for words_of_name, category in reversed(FILENAMES):
        fits = contains_any(F.col("filename"), words_of_name)
        name = F.when(fits & death if category in DEATH_ONLY else fits, F.lit(category)).otherwise(name)
    rows = rows.withColumn("_c", by_text).withColumn("_n", name)
    name_confidence = F.when(F.coalesce("filename", F.lit("")) == "", 0.0).when(F.col("_n").isNotNull(), 0.5).otherwise(0.1)
    use_name = (F.col("_c") < 0.5) & (name_confidence > F.col("_c"))
    by_priority = F.create_map(*[F.lit(x) for c in KEYWORDS for x in (PRIORITY[c], c)])
    by_words = F.try_element_at(by_priority, F.pmod("_b", F.lit(1000)))
    category = F.when(use_name, F.coalesce("_n", F.lit("other_evidence"))).otherwise(F.coalesce(by_words, F.lit("other_evidence")))
    return rows.withColumn("category", category).withColumn("confidence", F.when(use_name, name_confidence).otherwise(F.col("_c"))).drop("_b", "_c", "_n")


def doc_type(text: Column) -> Column:
    out = F.lit("other")
    for words, kind in reversed(DOC_TYPES):
        out = F.when(contains_any(text, words), F.lit(kind)).otherwise(out)
    return out


def with_word(text: Column, words: str) -> Column:
    """Whether one of words (an alternation) is in a text. A place is looked at closely only if a word can begin there."""
    first = "".join(sorted({w[0] for w in words.split("|")}))
    return text.rlike(f"(?=[{first}])(?:{words})")


def importance(text: Column) -> Column:
    """0 for paragraphs that decide a case, 1 for important ones, 2 for others."""
    return F.when(with_word(text, CRITICAL), 0).when(with_word(text, IMPORTANT), 1).otherwise(2)


def extracted(text: Column) -> Column:
    """struct of title, doc_type and the fields of identity and treatment that the rules find; null where they don't.

    A pattern is only tried on a text that has one of its words, which is far cheaper to see.
    """
    title = F.substring(F.split(stripped(text), "\n")[0], 1, 100)
    fields = {k: F.when(contains_any(text, words), stripped(first_group(text, p, g))) for k, (p, g, words) in {**IDENTITY, **TREATMENT}.items()}
    return F.struct(title.alias("title"), doc_type(text).alias("doc_type"), *[v.alias(k) for k, v in fields.items()])


def relations(text: Column) -> Column:
    """struct of legal_representative, relationship, symptoms and total_amount (0 without one) as the rules find them."""
    related, symptom, total = r"(法定代理人|监护人|亲属|近亲属)[：:\s]*([^\n，。]{2,10})", r"(主诉|症状|因)[：:\s]*([^\n。]{10,200})", r"(合计|总计|金额|费用合计)[：:\s]*[¥￥]?([\d,.]+)"
    amount = F.regexp_replace(first_group(text, total, 2), ",", "").try_cast("double")
    return F.struct(stripped(first_group(text, related, 2)).alias("legal_representative"), first_group(text, related, 1).alias("relationship"), stripped(first_group(text, symptom, 2)).alias("symptoms"), F.coalesce(amount, F.lit(0.0)).alias("total_amount"))


def line_items(materials: DataFrame) -> DataFrame:
    """material_id, place, fee_type and amount of every fee that a text lists (words that end in 费, then a number); what is no number is left out."""
    pattern = F.lit(r"([\x{4e00}-\x{9fff}]+费)[：:\s]*[¥￥]?([\d,.]+)")
    found = F.arrays_zip(F.regexp_extract_all("ocr_text", pattern, F.lit(1)).alias("fee_type"), F.regexp_extract_all("ocr_text", pattern, F.lit(2)).alias("n"))
    rows = materials.where(F.col("ocr_text").contains("费")).select("material_id", F.posexplode(found).alias("place", "f"))
    amount = F.regexp_replace("f.n", ",", "").try_cast("double")
    return rows.select("material_id", "place", F.col("f.fee_type").alias("fee_type"), amount.alias("amount")).where("amount is not null")


def edited(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """catalog (case_id, material_id, category, title, description, purpose, catalog_index) with manual edits: of several edits of
    a material (seq) each field's last that is not null wins. Edits of materials that are not in the case are passed over."""
    fields = ("category", "title", "description", "purpose", "catalog_index")
    last = edits.groupBy("case_id", "material_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields])
    rows = catalog.join(last, ["case_id", "material_id"], "left")
    return rows.select("case_id", "material_id", *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def placeholders(results: DataFrame) -> DataFrame:
    """results (paragraph_1 .. paragraph_5, defendant_name, plaintiff_name, court_name, n_plaintiffs) with failed, pending and missing:
    paragraphs that could not be generated, fields and paragraphs that are still to be filled in, and names that must not be empty."""
    listed = lambda *items: F.concat_ws(",", F.array_compact(F.array(*items)))
    paragraphs = [f"paragraph_{i}" for i in range(1, 6)]
    named = {"defendant_name": "被告医院名称", "plaintiff_name": "原告姓名", "court_name": "受理法院"}
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return results.select(
        "*",
        listed(*[F.when(F.col(p).rlike(T.FAILED_MARK), p) for p in paragraphs]).alias("failed"),
        listed(*[F.when(F.col(k).rlike(T.PENDING_MARK), v) for k, v in named.items()], *[F.when(F.col(p).rlike(T.PENDING_MARK), f"{p} 段落") for p in paragraphs]).alias("pending"),
        listed(F.when((F.coalesce("n_plaintiffs", F.lit(0)) == 0) & blank("plaintiff_name"), "原告姓名"), F.when(blank("defendant_name"), "被告医院名称")).alias("missing"),
    )


def template_key(case_type: Column, is_minor: Column) -> Column:
    """The template of a case: by type (an unknown one counts as injury) and whether the person concerned is a minor; neonatal cases are of minors."""
    minor = F.coalesce(is_minor, F.lit(False)) | F.coalesce(case_type == "neonatal", F.lit(False))
    return F.concat(F.when(case_type == "death", "death").otherwise("injury"), F.when(minor, "_minor").otherwise("_adult"))


def sections_shown(has_transfer: Column, has_appraisal: Column, has_staff_issue: Column) -> Column:
    """The paragraphs of a document that have data behind them: the first two always, the others by what there is."""
    yes = lambda c, name: F.when(F.coalesce(c, F.lit(False)), name)
    return F.array_compact(F.array(F.lit("paragraph_1"), F.lit("paragraph_2"), yes(has_transfer, "paragraph_3"), yes(has_appraisal, "paragraph_4"), yes(has_staff_issue, "paragraph_5")))


def mothers(plaintiffs: DataFrame) -> DataFrame:
    """case_id and mother_name of cases whose plaintiffs (seq, name, relationship, gender, is_patient) tell it: the first whose
    relationship says so, else, where that one has no name or there is none, the first woman who is not the patient."""
    said = F.coalesce(F.col("relationship").contains("母"), F.lit(False))
    woman = F.coalesce(F.col("gender").contains("女"), F.lit(False)) & ~F.coalesce("is_patient", F.lit(False))
    first = lambda which: F.nullif(F.min_by(F.coalesce("name", F.lit("")), F.when(which, F.col("seq"))), F.lit(""))
    return plaintiffs.groupBy("case_id").agg(F.coalesce(first(said), first(woman)).alias("mother_name")).where("mother_name is not null")


def backfilled(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """key and fields, each from the first of the sources (one row a key each) where it is neither null nor empty."""
    out = None
    for k, source in enumerate(sources):
        rows = source.select(key, *[F.nullif(F.col(f), F.lit("")).alias(f"_{k}_{f}") for f in fields])
        out = rows if out is None else out.join(rows, key, "full_outer")
    return out.select(key, *[F.coalesce(*[f"_{k}_{f}" for k in range(len(sources))]).alias(f) for f in fields])


def by_date(events: DataFrame, key: str, date: str, order: str) -> DataFrame:
    """events with place, their number within a key by their date as written; what is no date comes last, ties go by order."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(T.parsed_date(F.col(date))), order)
    return events.withColumn("place", F.row_number().over(w).cast("int"))


def merged(rule: dict[str, Column], model: dict[str, Column]) -> dict[str, Column]:
    """Field by field, the model's answer unless null or empty, else the rules'; of amounts the rules' first, unless null or 0."""
    out = {k: F.coalesce(F.nullif(model[k], F.lit("")), F.nullif(rule[k], F.lit(""))) for k in rule if k != "total_amount"}
    if "total_amount" in rule:
        out["total_amount"] = F.coalesce(F.nullif(rule["total_amount"], F.lit(0.0)), F.nullif(model["total_amount"], F.lit(0.0)), F.lit(0.0))
    return out


def coverage(fields: list[Column], n_items: Column, total: Column) -> Column:
    """The share of filled fields; fee items and a total that is not 0 count as fields."""
    filled = sum((F.coalesce((f != "").cast("int"), F.lit(0)) for f in fields), F.lit(0)) + n_items + F.coalesce((total != 0).cast("int"), F.lit(0))
    return filled / (F.lit(len(fields)) + n_items + 1)


def category_rank(category: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, ORDER)), category)
    return F.when(place > 0, place).otherwise(len(ORDER) + 1)


def catalog(materials: DataFrame) -> DataFrame:
    """Materials with their number in the case's catalog (from 1) and in their group: by category order, then age, then id."""
    rank = category_rank(F.col("category"))
    w = Window.partitionBy("case_id").orderBy(rank, "created_at", "material_id")
    g = Window.partitionBy("case_id", "category").orderBy("created_at", "material_id")
    return materials.withColumn("catalog_index", F.row_number().over(w)).withColumn("group_index", F.row_number().over(g))


def page_ranges(groups: DataFrame) -> DataFrame:
    """First and last estimated page of each group of a case: identity four to a page, records one each, others three to a page."""
    n = F.col("n_items")
    pages = F.when(F.col("category").startswith("identity"), F.ceil(n / 4)).when(F.col("category").isin("medical_record", "appraisal", "death_certificate"), n).otherwise(F.ceil(n / 3)).cast("long")
    w = Window.partitionBy("case_id").orderBy(category_rank(F.col("category")), "category").rowsBetween(Window.unboundedPreceding, 0)
    rows = groups.withColumn("pages", pages)
    last = F.sum("pages").over(w)
    return rows.withColumn("page_start", last - F.col("pages") + 1).withColumn("page_end", last)


def requirement_coverage(requirements: DataFrame, cases: DataFrame, materials: DataFrame) -> DataFrame:
    """Per case and requirement of its type: has_evidence, and status ok or missing."""
    present = materials.where("category is not null").select("case_id", "category").distinct().withColumn("_p", F.lit(True))
    rows = cases.join(F.broadcast(requirements), "case_type").join(present, ["case_id", "category"], "left")
    has = F.coalesce("_p", F.lit(False))
    return rows.select("case_id", "category", "is_required", has.alias("has_evidence"), F.when(has | ~F.col("is_required"), "ok").otherwise("missing").alias("status"))


def paired(cards: DataFrame) -> DataFrame:
    """Front and back of cards by name (the last of each side wins), with those that have no other side."""
    side = lambda s: cards.where(F.col("side") == s).groupBy("case_id", "name").agg(F.max_by("material_id", "seq").alias(s))
    return side("front").join(side("back"), ["case_id", "name"], "full_outer")


def phrase_pages(pages: DataFrame, phrases: DataFrame, least: int = 2) -> DataFrame:
    """Pages of a document that contain at least `least` of its phrases; a document's phrases come to its pages as one array."""
    by_document = phrases.groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases"))
    counted = pages.join(by_document, "doc_id").withColumn("n_phrases", F.size(F.filter("phrases", lambda p: F.contains(F.col("text"), p))).cast("long"))
    return counted.where(F.col("n_phrases") >= least).select("doc_id", "page", "n_phrases")


def estimated_pages(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Pages at and beside the place that a phrase's position in the whole text suggests; texts: doc_id, text, pages."""
    per = F.greatest(F.length("text") / F.greatest("pages", F.lit(1)), F.lit(100.0))
    found = texts.join(phrases, "doc_id").withColumn("_at", F.expr("instr(text, phrase)") - 1).where("_at >= 0")
    around = found.withColumn("_p", F.floor(F.col("_at") / per).cast("int")).select("doc_id", "pages", F.explode(F.sequence(F.col("_p") - 1, F.col("_p") + 1)).alias("page"))
    return around.where("page >= 0 and page < pages").select("doc_id", "page").distinct()


def most_frequent(names: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """The name that comes most often in each group, the earlier one in a tie."""
    counts = names.groupBy(*keys, name).agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(name, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("b")).select(*keys, f"b.{name}", "b.n")


def purposes(items: DataFrame) -> DataFrame:
    """Per case and category, the different purposes in order, joined."""
    return items.where("purpose <> ''").groupBy("case_id", "category").agg(F.array_join(F.sort_array(F.collect_set("purpose")), "；").alias("purposes"))


def batched(rows: DataFrame, group: str, order: str, size: int = 5, spread: int = 10_000) -> DataFrame:
    """rows with batch, the number of the batch of `size` rows that each is in by order (whole numbers) within its group.

    Rows are numbered within ranges of `spread` values of order, after the counts of the ranges before: a large group is dealt
    to as many tasks as it has ranges, and only the counts of a group's ranges meet.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / spread))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), before.alias("_before"))
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1)
    met = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_range").eqNullSafe(F.col("_at")))
    return met.select(*rows.columns, F.floor((F.col("_before") + F.col("_k")) / size).cast("int").alias("batch"))


def packed_context(paragraphs: DataFrame, limit: int) -> DataFrame:
    """Per document, the paragraphs that fit limit characters: by importance, then order; each level stops at the first that
    does not fit, of which a start over 50 characters is taken.

    Only lengths are shuffled. What a level takes are its running sums up to the room that the levels before have left, so a pass
    over a document's rows, sorted once, settles a level.
    """
    marked = paragraphs.select("doc_id", "idx", F.coalesce(F.length("text"), F.lit(0)).alias("n"), importance(F.col("text")).alias("importance"))
    document = Window.partitionBy("doc_id")
    upto = Window.partitionBy("doc_id", "importance").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.repartition("doc_id").withColumn("c", F.sum("n").over(upto)).withColumn("room", F.lit(limit).cast("long")).withColumn("_room", F.col("room"))
    for level in range(LEVELS):
        own = F.col("importance") == level
        taken = F.coalesce(F.max(F.when(own & (F.col("c") <= F.col("_room")), F.col("c"))).over(document), F.lit(0))
        stops = F.coalesce(F.max(F.when(own, F.col("c"))).over(document), F.lit(0))
        rows = rows.withColumns({"_taken": taken, "_all": stops})
        left = F.col("_room") - F.col("_taken")
        rows = rows.withColumns({"room": F.when(own, F.col("_room")).otherwise(F.col("room")), "_room": F.when((F.col("_all") > F.col("_room")) & (left > START), 0).otherwise(left)})
    # the paragraph that does not fit is the one before which all fit; what is left for it is the room less all before it
    before, fits = F.col("c") - F.col("n"), F.col("c") <= F.col("room")
    part = (before <= F.col("room")) & (F.col("room") - before > START)
    kept = rows.where(fits | part).select("doc_id", "importance", "idx", F.when(fits, F.col("n")).otherwise(F.col("room") - before).cast("int").alias("n_chars"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("importance", "idx")) - 1
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), place.cast("int").alias("place"), F.col("idx").cast("int").alias("idx"), "n_chars")
