"""Lines of reports and small reshapings: titles, purposes, summaries, pages, phrases, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_group, stripped

# Names of categories, and what they prove.
NAMES = {
    "identity_id_card": "原告身份证信息", "identity_hukou": "户口本信息", "identity_other": "其他身份信息", "identity_defendant": "被告身份信息", "death_certificate": "死亡医学证明书",
    "medical_record": "病历资料", "appraisal": "司法鉴定意见书", "fee_receipt": "医疗费用及相关票据", "other_evidence": "其他证据",
}
NOT_MEDICAL = ("护理垫", "护理用品", "湿纸巾", "爽身粉", "护理床", "住宿", "酒店", "打车", "交通", "高铁", "飞机", "地铁", "救护车", "房租", "日常用品", "案件交办", "补充材料清单", "电子发票", "医疗器械发票", "收款收据")
RELATIONS = ("父亲", "母亲", "儿子", "女儿", "丈夫", "妻子", "配偶", "本人")
ROMAN = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")


def named(category: Column) -> Column:
    out = F.lit("其他证据")
    for key, name in NAMES.items():
        out = F.when(category == key, F.lit(name)).otherwise(out)
    return out


def title(category: Column, filename: Column, found: Column, patient: Column) -> Column:
    """The title that was found unless it is the file's name, else the category's with patient and file."""
    file = F.coalesce(F.nullif(filename, F.lit("")), F.lit("未命名文件"))
    usable = (F.coalesce(found, F.lit("")) != "") & (found != file)
    base = F.concat(named(category), F.lit("（"), file, F.lit("）"))
    return F.when(usable, found).when(F.coalesce(patient, F.lit("")) != "", F.concat(patient, F.lit(" - "), base)).otherwise(base)


def purpose(category: Column, patient: Column, total: Column, death: Column) -> Column:
    who = lambda other: F.coalesce(F.nullif(patient, F.lit("")), F.lit(other))
    amount = F.when(F.coalesce(total, F.lit(0.0)) != 0, F.concat(F.lit("，合计"), F.format_string("%.2f", total), F.lit("元"))).otherwise("")
    return (
        F.when(category == "identity_id_card", F.concat(F.lit("证明"), who("原告"), F.lit("的原告主体身份")))
        .when(category == "identity_hukou", F.concat(F.lit("证明"), who("原告"), F.lit("的户籍信息及家庭关系")))
        .when(category == "identity_other", F.concat(F.lit("证明"), who("原告"), F.lit("的身份关系")))
        .when(category == "identity_defendant", "证明被告的主体资格及医疗机构执业信息")
        .when(category == "medical_record", F.concat(F.lit("证明"), who("患者"), F.lit("的诊疗经过及损害后果")))
        .when(category == "fee_receipt", F.concat(F.lit("证明因医疗损害造成的经济损失"), amount, F.when(death, "（含死亡相关费用）").otherwise("")))
        .when(category == "appraisal", "证明医疗过错、因果关系及过错参与度")
        .when(category == "death_certificate", "证明患者死亡的事实")
        .otherwise("证明案件相关事实")
    )


def fee_text(items: DataFrame, most: int = 5) -> DataFrame:
    """Per case, its first fees in order as text, how many there are beyond, and the total."""
    line = F.concat("fee_type", F.lit(" "), F.format_string("%.2f", F.col("amount").cast("double")), F.lit("元"))
    rows = items.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("t")))).alias("l"), F.sum("amount").cast("double").alias("total"))
    more = F.when(F.size("l") > most, F.concat(F.lit(" 等共"), F.size("l").cast("string"), F.lit("项"))).otherwise("")
    total = F.when(F.col("total") != 0, F.concat(F.lit("，合计："), F.format_string("%.2f", "total"), F.lit("元"))).otherwise("")
    return rows.select("case_id", F.concat(F.array_join(F.slice(F.col("l.t"), 1, most), "；"), more, total).alias("summary"))


def is_medical_fee(heading: Column, filename: Column, text: Column) -> Column:
    """Whether a receipt is for treatment: ordered rules on its title, its file's name and the start of its text."""
    return (
        F.when(contains_any(heading, NOT_MEDICAL) | contains_any(filename, NOT_MEDICAL), False)
        .when(filename.contains("门诊") & contains_any(filename, ("费用", "收费")), True)
        .when(heading.contains("收费告知") | F.substring(text, 1, 200).contains("费用凭证"), True)
        .when(heading.contains("医保结算单") | F.substring(text, 1, 100).contains("医保结算单"), True)
        .when(heading.contains("住院") & heading.contains("清单"), True)
        .when(contains_any(heading, ("材料清单", "登记表")), False)
        .otherwise(F.substring(text, 1, 500).rlike(r"[\x{4e00}-\x{9fa5}]{2,8}(人民医院|中心医院|附属医院)"))
    )


def from_filename(filename: Column) -> Column:
    """struct(name, relation) of a file called like 父亲张三身份证.jpg or 张三（父亲）.jpg; null parts where it says none."""
    relation = "|".join(RELATIONS)
    before = F.regexp_extract(filename, rf"({relation})[-_ ]?([\x{{4e00}}-\x{{9fff}}]{{2,4}}?)(?:身份证|户口|[.（(]|$)", 2)
    after = F.regexp_extract(filename, rf"([\x{{4e00}}-\x{{9fff}}]{{2,4}})[（(](?:{relation})[）)]", 1)
    return F.struct(F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).alias("name"), first_group(filename, rf"({relation})").alias("relation"))


def reattached(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """blocks whose level is null with the level of the last heading of the same text in their document."""
    levels = headings.where("level is not null").groupBy("doc_id", stripped(F.col("text")).alias("_t")).agg(F.max_by("level", "idx").alias("_l"))
    rows = blocks.withColumn("_t", stripped(F.col("text"))).join(levels, ["doc_id", "_t"], "left")
    return rows.withColumn("level", F.coalesce("level", "_l")).drop("_t", "_l")


def confirmed(people: DataFrame, texts: DataFrame) -> DataFrame:
    """People (case_id, id_number) whose number stands in one of their case's texts, and those without a number."""
    found = texts.select("case_id", F.explode(F.regexp_extract_all("ocr_text", F.lit(r"(\d{17}[\dXx])"), F.lit(1))).alias("id_number")).distinct()
    without = F.coalesce("id_number", F.lit("")) == ""
    return people.where(without).unionByName(people.where(~without).join(found, ["case_id", "id_number"], "left_semi").select(*people.columns))


def shares(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """Sum by key and its share of all in percent, two places."""
    sums = rows.groupBy(key).agg(F.sum(amount).alias("total"))
    return sums.withColumn("share", F.round(F.col("total") * 100 / F.sum("total").over(Window.partitionBy(F.lit(1))), 2))


def lowest(lines: DataFrame, most: int = 5) -> DataFrame:
    """The lines of least confidence of each document, in order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("conf", "idx"))
    return lines.withColumn("place", place).where(F.col("place") <= most)


def numbered_groups(groups: DataFrame) -> DataFrame:
    """Groups of a case with their heading number in words, in order of rank."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))
    words = F.array(*map(F.lit, ROMAN))
    return groups.withColumn("heading", F.coalesce(F.try_element_at(words, place), place.cast("string")))


def image_pages(images: DataFrame) -> DataFrame:
    """Images of a case with the page that they go to: identity four to a page, fees two, others one; each category starts anew."""
    per = F.when(F.col("category").startswith("identity"), 4).when(F.col("category") == "fee_receipt", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy("case_id", "category").orderBy("material_id")) - 1
    return images.withColumn("page", F.floor(place / per).cast("int")).withColumn("slot", F.pmod(place, per).cast("int"))


def phrases(texts: DataFrame, least: int = 3, most: int = 80) -> DataFrame:
    """Phrases of a text between marks, each once at its first place, of least to most characters: doc_id, phrase, place."""
    parts = texts.select("doc_id", F.posexplode(F.split("text", r"[，。；,.;\n]")).alias("i", "phrase")).withColumn("phrase", stripped(F.col("phrase")))
    kept = parts.where(F.length("phrase").between(least, most)).groupBy("doc_id", "phrase").agg(F.min("i").alias("place"))
    return kept


def states(changes: DataFrame) -> DataFrame:
    """Last state, retries and time in all of each task, from its changes (task_id, seq, status, at in seconds); a retry starts over."""
    last_start = F.max(F.when(F.col("status") == "retrying", F.col("seq")))
    return changes.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "retrying").alias("retries"), (F.max("at") - F.min("at")).alias("seconds"), last_start.alias("last_retry"))


def consecutive(items: DataFrame) -> DataFrame:
    """Per document whether its numbers (two or more) follow each other by one."""
    w = Window.partitionBy("doc_id").orderBy("number")
    steps = items.withColumn("_d", F.col("number") - F.lag("number").over(w))
    return steps.groupBy("doc_id").agg(((F.count("*") >= 2) & (F.coalesce(F.min("_d"), F.lit(0)) == 1) & (F.coalesce(F.max("_d"), F.lit(0)) == 1)).alias("consecutive"))


def circled_run(items: DataFrame) -> DataFrame:
    """Items (doc_id, pos, number) of the first run: up to the first number that falls back after two or more."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("number").over(w)
    broken = F.when((F.col("number") <= before) & (before >= 2), 1).otherwise(0)
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("_b", broken).withColumn("_s", F.sum("_b").over(upto)).where("_s = 0").drop("_b", "_s")


def bounds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest box around the points of a group's four-point boxes: x, y, w, h."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return boxes.groupBy(*keys).agg(F.min(F.array_min(xs)).alias("x"), F.min(F.array_min(ys)).alias("y"), F.max(F.array_max(xs)).alias("_r"), F.max(F.array_max(ys)).alias("_b")).select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"))


def notice_fields(text: Column) -> Column:
    """struct of kind, number, organisation and last date of an official notice."""
    kind = F.when(contains_any(text, ("通知",)), "notice").when(contains_any(text, ("决定",)), "decision").when(contains_any(text, ("公告",)), "announcement").when(contains_any(text, ("报告",)), "report").otherwise("other")
    dates = F.regexp_extract_all(text, F.lit(r"\d{4}年\d{1,2}月\d{1,2}日"), F.lit(0))
    return F.struct(kind.alias("kind"), first_group(text, r"([\x{4e00}-\x{9fff}]{1,6}[〔\[（(]\d{4}[〕\]）)]\d+号)").alias("number"), first_group(text, r"([\x{4e00}-\x{9fff}]{2,20}(?:委员会|局|厅|部|院|政府))").alias("organisation"), F.try_element_at(dates, F.lit(-1)).alias("date"))
