"""Fields of a case that are read from its materials by rules: parties, conclusions, diagnoses, qualifications.

materials: case_id, material_id (order), category, filename, ocr_text. Fields come out of generated
code; a case's value is an aggregate with an order, so no task holds a case's texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_group, normalized_date, stripped

# Labels, words and orders of precedence.
PARTY_ORDER = ("identity_defendant", "fee_receipt", "medical_record", "death_certificate", "appraisal")
CONTRACT = ("委托", "合同", "甲方", "乙方", "委托方", "受托方", "律所", "律师事务所")
CONCLUSION_LABELS = ("鉴定意见", "鉴定结论", "分析说明", "检验结果")
STAFF = r"(?:经治医师|主治医师|住院医师|手术医师|麻醉医师|主刀医师|管床医师|接诊医师)[：:]\s*([\x{4e00}-\x{9fff}]{2,4})"
ISSUES = ((r"无证执业|未取得.*执业资格", "无证执业"), (r"未注册", "未注册"), (r"执业证.*过期", "注册过期"), (r"超范围执业", "超范围执业"))
INSTITUTIONS = ("医院", "卫生院", "诊所", "保健院", "中心", "医务室", "门诊", "卫生室")
DEATH_ORDER = ("appraisal", "medical_record", "death_certificate")
DEATH_LABELS = ("死亡诊断意见", "死亡诊断", "尸检诊断", "解剖诊断", "病理诊断", "死因分析", "死亡原因分析", "死亡原因", "鉴定意见", "鉴定结论", "检验结果")
DEATH_WORDS = r"死亡|衰竭|濒死|无效|心跳骤停|呼吸骤停|循环衰竭|多器官功能衰竭|肺栓塞"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"
STAINED = r"[第]\d+页|病鉴字|法鉴中心|共\d+页|[A-Z]\d{4,}|报告单"
HAN = r"\x{4e00}-\x{9fff}"


def rank(category: Column, order: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(place > 0, place).otherwise(99)


def first_by(value: Column, order: Column) -> Column:
    """The first value that is not null in an order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def defendants(materials: DataFrame, head: int = 500) -> DataFrame:
    """Per case: name (the longest, of names with an alias in brackets or after 被告), representative, code and address of the defendant.

    A name's part before 与, 和 or 及 is cut off, where they stand before the first 医院. All but the name come from the defendant's own papers
    alone, the address not from contracts (by the file name, or a word in the first `head` characters); each field is the first
    that is found.
    """
    text = F.col("ocr_text")
    order = F.struct(rank(F.col("category"), PARTY_ORDER).alias("r"), F.col("material_id").alias("m"))
    party = F.col("category").isin(*PARTY_ORDER)
    found = materials.select(
        "*", F.when(party & contains_any(text, ("医院（", "医院(")), first_group(text, rf"([{HAN}]{{2,10}}医院[（(][{HAN}]+医院[）)])")).alias("_alias"),
        F.when(party & text.contains("被告"), first_group(text, rf"被告([{HAN}]{{2,10}}医院)")).alias("_simple"),
    )
    alias, simple = F.col("_alias"), F.col("_simple")
    cut = F.regexp_replace(alias, r"^(?:(?!医院).)*[与和及]", "")
    alias = F.when(F.split(alias, "医院")[0].rlike("[与和及]") & cut.contains("医院"), cut).otherwise(alias)
    own = F.col("category") == "identity_defendant"
    contract = contains_any(F.lower(F.coalesce("filename", F.lit(""))), CONTRACT) | contains_any(F.substring(text, 1, head), CONTRACT)
    person = F.when(own, F.coalesce(first_group(text, rf"法定代表人[：:]\s*([{HAN}]{{2,4}})"), first_group(text, rf"法定代表人[^\n]*\n\s*([{HAN}]{{2,4}})\s*\n")))
    code = F.when(own, first_group(text, r"统一社会信用代码[：:\s]*([A-Z0-9]{18})"))
    address = F.when(own & ~contract, F.coalesce(first_group(text, rf"(?:地址|住所)[：:]\s*([{HAN}]+省[{HAN}]+[路段街道][{HAN}]*\d*号?)"), first_group(text, rf"(?:注册地址|地址|住所)[^\n]*\n\s*([{HAN}]+[路段街道][{HAN}]*\d*号?)")))
    rows = found.select("case_id", order.alias("o"), alias.alias("alias"), simple.alias("simple"), person.alias("p"), code.alias("c"), address.alias("a"))
    # of a paper's two names the longer one, the alias in a tie
    name = F.when(F.length("simple") > F.coalesce(F.length("alias"), F.lit(-1)), F.col("simple")).otherwise(F.col("alias"))
    rows = rows.withColumns({"name": name, "a": F.when(F.length("a") >= 4, F.col("a"))})
    longest = F.struct(-F.length("name"), F.col("o.r"), F.col("o.m"))
    # exploded, so that the filter does not run the patterns a second time
    rows = rows.select("case_id", "o", F.explode(F.array(F.struct("name", "p", "c", "a"))).alias("f")).where("coalesce(f.name, f.p, f.c, f.a) is not null").select("case_id", "o", "f.*")
    return rows.groupBy("case_id").agg(
        first_by(F.col("p"), F.col("o")).alias("legal_representative"), first_by(F.col("c"), F.col("o")).alias("credit_code"), first_by(F.col("a"), F.col("o")).alias("defendant_address"), first_by(F.col("name"), longest).alias("defendant_name"),
    )


def appraisals(materials: DataFrame, most: int = 1200) -> DataFrame:
    """Per case, of the first appraisal that yields anything: the conclusion (within `most` characters after its label), appraisers' names and numbers, and the institution."""
    text = F.col("ocr_text")

    def after(label: str) -> Column:
        tail = F.substring(F.regexp_extract(text, rf"(?s){label}[：:]\s*(.*)", 1), 1, most)
        tail = stripped(F.regexp_replace(F.regexp_replace(tail, r"第\d+页共\d+页", ""), r"(?s)[四五六七八九十]+、.*", ""))
        return F.when(F.length(tail) > 10, tail)

    section = F.regexp_extract(text, r"(?s)(?:司法鉴定人|鉴定人)[：:]\s*(.*?)(?:\n\n|第\d+页|$)", 1)
    marked = rf"([{HAN}]{{2,4}})[（(]?\s*(?:证号|执业证号|编号)[：:]*\s*([A-Z0-9]+)[）)]?"
    names, numbers = (F.regexp_extract_all(section, F.lit(marked), F.lit(g)) for g in (1, 2))
    plain = F.filter(F.array_distinct(F.regexp_extract_all(section, F.lit(rf"([{HAN}]{{2,4}})"), F.lit(1))), lambda n: ~n.isin("鉴定人", "司法", "执业", "证号"))
    org = first_group(text, rf"([{HAN}]{{2,15}}(?:司法鉴定中心|司法鉴定所|法医鉴定中心|鉴定中心|鉴定所))")
    rows = materials.where("category = 'appraisal' and ocr_text <> ''").select(
        "case_id", "material_id", F.coalesce(*map(after, CONCLUSION_LABELS)).alias("conclusion"), F.concat_ws(",", F.when(F.size(names) > 0, names).otherwise(plain)).alias("appraisers"), F.concat_ws(",", numbers).alias("licences"), org.alias("organisation")
    )
    found = rows.where((F.col("conclusion").isNotNull()) | (F.col("appraisers") != "") | F.col("organisation").isNotNull())
    return found.groupBy("case_id").agg(F.min_by(F.struct("conclusion", "appraisers", "licences", "organisation"), "material_id").alias("f")).select("case_id", "f.*")


def staff(materials: DataFrame) -> DataFrame:
    """Per case, of the first paper on staff that yields anything: name, issue, number and scope of practice."""
    text = F.col("ocr_text")
    issue = F.lit(None).cast("string")
    for pattern, label in reversed(ISSUES):
        issue = F.when(text.rlike(pattern), label).otherwise(issue)
    rows = materials.where(F.col("category").isin("identity_defendant", "medical_record") & (text != "")).select(
        "case_id", "material_id", first_group(text, STAFF).alias("staff_name"), issue.alias("issue_type"), first_group(text, r"执业证号[：:]\s*(\d{10,20})").alias("staff_license_no"), first_group(text, rf"执业范围[：:]\s*([{HAN}]{{2,20}})").alias("staff_scope")
    )
    fields = ("staff_name", "issue_type", "staff_license_no", "staff_scope")
    found = rows.where(F.coalesce(*fields).isNotNull())
    return found.groupBy("case_id").agg(F.min_by(F.struct(*fields), "material_id").alias("f")).select("case_id", "f.*")


def validation_issues(cases: DataFrame) -> DataFrame:
    """cases (case_type, id_number, defendant_name, phone, death_date, death_diagnosis) with issues, and id and date made good."""
    name, phone, number = (F.coalesce(c, F.lit("")) for c in ("defendant_name", "phone", "id_number"))
    bad_id = (number != "") & ~number.rlike(r"^\d{17}[\dXx]$")
    death = F.col("case_type") == "death"
    issues = F.array_compact(
        F.array(
            F.when(bad_id, "id_number"),
            F.when(name == "", "defendant_missing").when(F.length(name) < 4, "defendant_short"),
            F.when((name != "") & ~contains_any(name, INSTITUTIONS), "defendant_kind"),
            F.when((phone != "") & ~phone.rlike(r"^[\d\-+()]{6,15}$"), "phone"),
            F.when(death & (F.coalesce("death_date", F.lit("")) == ""), "death_date"),
            F.when(death & (F.coalesce("death_diagnosis", F.lit("")) == ""), "death_diagnosis"),
        )
    )
    return cases.withColumn("issues", F.concat_ws(",", issues)).withColumn("id_number", F.when(~bad_id, F.col("id_number"))).withColumn("death_date", normalized_date(F.col("death_date")))


def output_group(category: Column, filename: Column) -> Column:
    """The group of the output that a material goes to; null for none."""
    name = F.coalesce(filename, F.lit(""))
    return (
        F.when(contains_any(name, ("资质", "资格")), "staff_qual")
        .when(contains_any(name, ("死亡证明", "死亡医学")), "other_identity")
        .when(category.isin("identity_id_card", "identity_hukou"), "plaintiff_id")
        .when(category == "identity_defendant", "defendant")
        .when(category.isin("identity_other", "death_certificate"), "other_identity")
        .when(category == "medical_record", "medical")
        .when(category.isin("appraisal", "fee_receipt"), category)
    )


def youngest(plaintiffs: DataFrame) -> DataFrame:
    """plaintiffs (case_id, seq, name, birth_date) with is_patient: the one born last, the first in a tie; no year counts as 0."""
    year = F.coalesce(F.regexp_extract("birth_date", r"(\d{4})", 1).try_cast("int"), F.lit(0))
    w = Window.partitionBy("case_id").orderBy(F.desc(year), "seq")
    return plaintiffs.withColumn("is_patient", F.row_number().over(w) == 1)


def numbered_columns(plaintiffs: DataFrame, width: int = 3) -> DataFrame:
    """One row a case with name_1 .. name_<width> in order of seq (null where there are fewer), and in more_names an array of the
    names beyond, empty where there are none: no name is lost, however many a case has."""
    rows = plaintiffs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("p"))
    names = [F.try_element_at("p", F.lit(i))["name"].alias(f"name_{i}") for i in range(1, width + 1)]
    return rows.select("case_id", *names, F.transform(F.slice("p", width + 1, F.greatest(F.size("p"), F.lit(1))), lambda x: x["name"]).alias("more_names"))


def numbered_rows(wide: DataFrame, width: int = 3) -> DataFrame:
    """The names of numbered columns, and of more_names if wide has it, as rows up to the first gap (a null or empty name)."""
    names = F.array(*[F.col(f"name_{i}") for i in range(1, width + 1)])
    if "more_names" in wide.columns:
        names = F.concat(names, F.coalesce("more_names", F.array().cast("array<string>")))
    rows = wide.select("case_id", F.transform(names, lambda n: F.nullif(n, F.lit(""))).alias("names"))
    gap = F.array_position(F.transform("names", lambda n: n.isNull()), F.lit(True))
    upto = F.when(gap > 0, gap - 1).otherwise(F.size("names")).cast("int")
    return rows.select("case_id", F.posexplode(F.slice("names", 1, upto)).alias("seq", "name"))


def best_amount(summary: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Per case the positive amount whose fee type fits best: equal to a keyword, containing one, contained in one; the earlier in a tie."""
    words = F.posexplode(F.array(*map(F.lit, keywords))).alias("k", "word")
    score = F.when(F.col("fee_type") == F.col("word"), 100).when(F.col("fee_type").contains(F.col("word")), 50).when(F.col("word").contains(F.col("fee_type")), 25)
    rows = summary.where("amount > 0").select("*", words).withColumn("score", score).where("score is not null")
    return rows.groupBy("case_id").agg(F.max_by(F.struct("fee_type", "amount", "score"), F.struct(F.col("score"), -F.col("k"), -F.col("seq"))).alias("b")).select("case_id", "b.*")


def with_required(schema: dict, column: str = "answer") -> Column:
    """A struct of a JSON schema's required fields from a JSON column, with the type's default where the answer has none."""
    defaults = {"string": F.lit("[待补充]"), "number": F.lit(0.0), "integer": F.lit(0).cast("long"), "boolean": F.lit(False)}
    casts = {"string": "string", "number": "double", "integer": "long", "boolean": "boolean"}

    def fields(node: dict, path: str) -> Column:
        out = []
        for key in node.get("required", []):
            kind = node.get("properties", {}).get(key, {})
            here = f"{path}.{key}"
            if kind.get("type") == "object":
                out.append(fields(kind, here).alias(key))
            else:
                name = kind.get("type", "string")
                found = F.get_json_object(F.col(column), here)
                out.append(F.coalesce(found.try_cast(casts.get(name, "string")), defaults.get(name, defaults["string"])).alias(key))
        return F.struct(*out)

    return fields(schema, "$")


def death_diagnosis(materials: DataFrame, most: int = 800, most_discharge: int = 600, items: int = 5) -> DataFrame:
    """Per case the diagnosis of death: after the first label of the first paper by category, as circled items, as numbered
    items, as phrases between semicolons, or as a sentence, within `most` characters; else the first `items` of the discharge
    diagnosis (within `most_discharge` characters) that speak of death.

    A paper is read in Python, as circled items go on until their numbers fall back; papers are read by partition, and the
    first of a case that yields anything is taken by an aggregate.
    """
    import re

    order = {c: i for i, c in enumerate(DEATH_ORDER)}

    def read(text: str) -> str | None:
        match = next((m for m in (re.search(label + r"[：:]\s*", text) for label in DEATH_LABELS) if m), None)
        if not match:
            return None
        tail = text[match.end() : match.end() + most]
        circled, last = [], 0
        for m in re.finditer(rf"([{CIRCLED}])([^{CIRCLED}\n]+)", tail):
            content, number = m[2].strip().rstrip("；;，,。．."), CIRCLED.index(m[1]) + 1
            if re.search(STAINED, content):
                continue
            if number <= last and last >= 2:
                break
            circled.append(m[1] + content)
            last = number
        if circled:
            return "；".join(circled)
        numbered = sorted((int(m[1]), m[2].strip().rstrip("；;，,。．.")) for m in re.finditer(r"(\d{1,2})[.、．]\s*([^\n；;1-9]+)", tail) if int(m[1]) <= 15 and not re.search(STAINED, m[2]))
        if len(numbered) >= 2 and all(b[0] == a[0] + 1 for a, b in zip(numbered, numbered[1:])):
            return "；".join(f"{n}.{c}" for n, c in numbered)
        phrase = r"[一-鿿()][一-鿿()0-9a-zA-Z+＋\-－%％Ⅰ-Ⅴ]{2,30}"
        m = re.search(rf"((?:{phrase}[；;]\s*){{2,8}}{phrase})[。．.]?", tail)
        if m:
            return m[1]
        m = re.search(r"[^。\n]{5,200}", tail)
        return m[0].rstrip("．.") if m else None

    def discharge(text: str) -> str | None:
        match = re.search(r"出院诊断[：:]\s*", text)
        if not match:
            return None
        found = re.findall(r"[①-⑩]?([一-鿿()][一-鿿()0-9a-zA-Z+＋\-－%％Ⅰ-Ⅴ]{2,40})", text[match.end() : match.end() + most_discharge])
        return "；".join([x for x in found if re.search(DEATH_WORDS, x)][:items]) or None

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                direct = read(r.ocr_text.strip())
                if direct:
                    rows.append((r.case_id, 0, order[r.category], r.material_id, direct))
                elif r.category != "appraisal" and (other := discharge(r.ocr_text.strip())):
                    rows.append((r.case_id, 1, order[r.category], r.material_id, other))
            yield pd.DataFrame(rows, columns=["case_id", "way", "place", "material_id", "death_diagnosis"])

    papers = materials.where(F.col("category").isin(*DEATH_ORDER) & F.col("ocr_text").isNotNull()).select("case_id", "material_id", "category", "ocr_text")
    found = papers.mapInPandas(run, "case_id long, way int, place int, material_id long, death_diagnosis string")
    return found.groupBy("case_id").agg(F.min_by("death_diagnosis", F.struct("way", "place", "material_id")).alias("death_diagnosis"))
