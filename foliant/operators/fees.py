"""Fee receipts, hospital totals and compensation items, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AMOUNT, contains_any, decimal_amount, double_or_null, first_date, iso_day, receipt_tail, unfenced

# Fee types by words in a file name, in order of precedence.
FILENAME_FEE_TYPES = (
    (("日常用品", "护理用品", "生活用品", "护理品", "陪护用品", "医疗器械", "医用器械", "康复器械", "辅助器具", "护理器械", "轮椅", "拐杖", "助行器", "护理床", "医用耗材"), "nursing_supplies", "护理用品/医疗器械"),
    (("住院清单", "住院费用", "住院发票", "住院结算"), "hospital_fee", "住院费用"),
    (("门诊费用", "门诊发票", "门诊清单", "门诊结算"), "outpatient_fee", "门诊费用"),
    (("医保结算", "医保报销", "医保清单"), "medical_fee", "医保结算"),
    (("外购药", "外购", "药店"), "pharmacy_fee", "外购药品费"),
)
TOTALS = ("合\\s*计", "总\\s*计", "费用合计")
MEDICAL_TYPES = ("medical_fee", "hospital_fee", "outpatient_fee", "pharmacy_fee")
INJURY_ITEMS = ("medical_fee", "lost_wages", "nursing_fee", "food_subsidy", "nutrition_fee", "disability_compensation", "dependent_living", "transport_fee", "appraisal_fee", "spiritual_damage")
DEATH_ITEMS = ("medical_fee", "lost_wages", "nursing_fee", "food_subsidy", "nutrition_fee", "death_compensation", "dependent_living", "funeral_fee", "transport_fee", "appraisal_fee", "spiritual_damage")
MONEY = "decimal(18,2)"


#: Fee types with their names, by the numbers that fee_code gives; the first are those of file names.
FEES = (*((kind, label) for _, kind, label in FILENAME_FEE_TYPES), ("medical_fee", "医疗费用"))


def fee_code(filename: Column, text: Column) -> Column:
    """The place in FEES, from 1, of the first rule with a word in the file name, else of what the text speaks of.

    None of the words has letters with two cases, so names are compared as they are.
    """
    code = (
        F.when(contains_any(text, ("住院", "入院")), 2)
        .when(text.contains("门诊"), 3)
        .when(text.contains("医保") & contains_any(text, ("结算", "报销")), 4)
        .when(contains_any(text, ("外购", "药店")), 5)
        .otherwise(6)
    )
    for k in range(len(FILENAME_FEE_TYPES), 0, -1):
        code = F.when(contains_any(filename, FILENAME_FEE_TYPES[k - 1][0]), k).otherwise(code)
    return code


#: A number as AMOUNT takes it that is above 0 in cents and fits MONEY.
POSITIVE = AMOUNT.replace("([", r"(?=[\d,]*[1-9]|[\d,]*\.0?[1-9]|[\d,]*\.00[5-9])(?!,*(?:0,*)*[1-9](?:,*\d){16})([")


def texts_after(text: Column, **words: tuple[str, str]) -> list[Column]:
    """By name the number, as text, that first follows a word (word, form of a number); empty without one.

    They are columns of their own before anything is made of them: a pattern runs once, and an empty text
    is never cast, as each failing cast raises and catches an exception.
    """
    return [F.regexp_extract(text, word + number, 1).alias(name) for name, (word, number) in words.items()]


def first_amount(*names: str) -> Column:
    """The amount of the first of texts_after() that is not empty and a number of MONEY, or null."""
    return F.coalesce(*[F.when(F.col(n) != "", decimal_amount(F.col(n))) for n in names])


#: The first positive amount after a word for total; the words are tried in order. What follows the last of TOTALS also follows the first.
TOTAL_TEXTS = {f"_total_{k}": (word, POSITIVE) for k, word in enumerate(TOTALS[:2])}


def parsed_receipts(receipts: DataFrame) -> DataFrame:
    """material_id, case_id, fee_type, description and amount of receipts (and filename, ocr_text) that state a total.

    The type is the file name's, else the text's. Receipts without a total, so also those without text, give no row.
    """
    text = F.col("ocr_text")
    found = receipts.select("material_id", "case_id", fee_code(F.col("filename"), text).alias("_code"), *texts_after(text, **TOTAL_TEXTS))
    # exploded, so that the filter on it does not compute it a second time
    out = found.select("material_id", "case_id", "_code", F.explode(F.array(first_amount(*TOTAL_TEXTS))).alias("amount")).where("amount is not null")
    named = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in FEES]), F.col("_code"))
    return out.select("material_id", "case_id", named(0).alias("fee_type"), named(1).alias("description"), "amount")


def receipt_details(receipts: DataFrame) -> DataFrame:
    """hospital, date, insurance, own share (total less insurance, not below 0) and tail number of each receipt."""
    text, none = F.col("ocr_text"), F.lit(0).cast(MONEY)
    found = receipts.select(
        "material_id", "case_id", "filename", F.regexp_extract(text, r"([^\n，。；:：]{2,20}?(?:医院|卫生院|诊所|卫生所))", 1).alias("_hospital"), first_date(text).alias("receipt_date"),
        *texts_after(text, **TOTAL_TEXTS, _fund=("统筹支付", AMOUNT), _insured=("医保支付", AMOUNT), _own=("个人(?:自付|支付)", AMOUNT)),
    )
    amounts = F.struct(F.coalesce(first_amount(*TOTAL_TEXTS), none).alias("total"), F.coalesce(first_amount("_fund", "_insured"), none).alias("insurance"), first_amount("_own").alias("own"))
    hospital = F.when(F.col("_hospital") != "", F.col("_hospital")).otherwise("未知医院")
    # exploded, so that a filter on an amount does not run the patterns a second time
    found = found.select("material_id", "case_id", "filename", hospital.alias("hospital"), "receipt_date", F.explode(F.array(amounts)).alias("_a"))
    own = F.coalesce("_a.own", F.greatest(F.col("_a.total") - F.col("_a.insurance"), none).cast(MONEY))
    return found.select("material_id", "case_id", "hospital", "receipt_date", "_a.total", "_a.insurance", own.alias("self_pay"), receipt_tail(F.col("filename")).alias("tail"))


def typed_items(receipts: DataFrame) -> DataFrame:
    """receipts (material_id, title, filename, hospital, date, total, insurance, own, amounts, admission, discharge) as rows of a report.

    A total that is not positive is the sum of the positive numbers among amounts (strings); a stay with both dates is 住院, with
    its days (null if negative or unreadable) and both dates for the date, anything else 门诊. Texts lose code fences and JSON.
    """
    number = lambda c: F.coalesce(double_or_null(F.replace(c, F.lit(","), F.lit(""))), F.lit(0.0))
    items = F.aggregate(F.coalesce("amounts", F.array().cast("array<string>")), F.lit(0.0), lambda acc, x: acc + F.greatest(F.coalesce(double_or_null(x), F.lit(0.0)), F.lit(0.0)))
    total = F.when(F.col("_total") > 0, F.col("_total")).otherwise(items)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    stay = filled("admission") & filled("discharge")
    day = lambda c: iso_day(F.substring(c, 1, 10))
    days = F.col("_days")
    text = lambda c: F.coalesce(unfenced(F.col(c)), F.lit(""))
    # columns of their own, so that they are not computed for the condition and for the value
    known = receipts.withColumns({"_total": number(F.col("total")), "_days": F.when(stay, F.date_diff(day("discharge"), day("admission")))})
    return known.select(
        "material_id", text("hospital").alias("hospital"), text("title").alias("title"),
        F.when(stay, F.concat(F.substring("admission", 1, 10), F.lit(" ~ "), F.substring("discharge", 1, 10))).otherwise(text("date")).alias("date"),
        total.alias("total"), number(F.col("insurance")).alias("insurance"), number(F.col("own")).alias("own"),
        F.when(stay, "住院").otherwise("门诊").alias("kind"), F.when(stay & (days >= 0), days).alias("days"), receipt_tail(F.coalesce("filename", F.lit(""))).alias("tail"),
    )


# Labels of amounts, in order of precedence.
SUM_LABELS, WHOLE_LABELS, OWN_WHOLE_LABELS = ("合计金额", "合计"), ("医疗费总额", "医疗费总预"), ("全自费金额", "全自费金别")
INSURANCE_LABELS = ("统筹支付", "基金支付总额", "医保支付总额")
OWN_LABELS = (("扫码付", "现金"), ("个人负担金额", "个人负担企额"), ("个人现金支出",))
SETTLEMENT = ("结算单", "医疗保障")
NUMBER = r"([\d,]+\.\d+|[\d,]+)"


def labelled_amount(text: Column, labels: tuple[str, ...]) -> Column:
    """The number beside the first label that has one: after a colon, in the line below, or in the line above; 0 without one.

    Labels go before places, and a place's first number counts, whatever it is. One pattern from the text's start tries a label's
    places in this order and leaves what it captured of the whole text, nothing where none fits; only labels that are there are tried.
    """
    filled = lambda c: F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))
    forms = (r"{}[：:]\s*" + NUMBER, r"{}\s*\n\s*" + NUMBER, NUMBER + r"\s*\n\s*{}")
    pattern = lambda label: "(?s)^(?:" + "|".join(f".*?{f.format(label)}" for f in forms) + "|).*"
    found = F.coalesce(*[filled(F.when(text.contains(label), F.regexp_replace(text, pattern(label), "$1$2$3"))) for label in labels])
    return F.coalesce(filled(F.replace(found, F.lit(","), F.lit(""))).try_cast("double"), F.lit(0.0))


def receipt_amounts(receipts: DataFrame, text: str = "t") -> DataFrame:
    """receipts with amount, insurance and self_pay by the labels beside them in their text.

    A settlement (by its first 200 characters) goes by the whole sum before the plain one, other receipts the other way round; the
    own share that is not stated is the rest of the amount after the insurance. Each sum is a column of its own, so that none is
    looked for again where it is used.
    """
    labels = {"_plain": SUM_LABELS, "_whole": WHOLE_LABELS, "_own_whole": OWN_WHOLE_LABELS, "_insurance": INSURANCE_LABELS, **{f"_own_{k}": x for k, x in enumerate(OWN_LABELS)}}
    rows = receipts.withColumns({k: labelled_amount(F.col(text), x) for k, x in labels.items()})
    settlement = contains_any(F.substring(text, 1, 200), SETTLEMENT)
    amount = F.when((F.col("_whole") > 0) & (settlement | (F.col("_plain") <= 0)), F.col("_whole")).when(F.col("_plain") > 0, F.col("_plain")).otherwise(F.col("_own_whole"))
    own = F.lit(0.0)
    for k in reversed(range(len(OWN_LABELS))):
        own = F.when(F.col(f"_own_{k}") != 0, F.col(f"_own_{k}")).otherwise(own)
    rows = rows.withColumns({"_amount": amount, "_own": own})
    rest = (F.col("_amount") > 0) & (F.col("_insurance") > 0) & (F.col("_own") == 0)
    self_pay = F.when(rest, F.round(F.col("_amount") - F.col("_insurance"), 2)).otherwise(F.col("_own"))
    return rows.select(*receipts.columns, F.col("_amount").alias("amount"), F.col("_insurance").alias("insurance"), self_pay.alias("self_pay"))


def by_hospital(details: DataFrame) -> DataFrame:
    """Subtotals by hospital and the grand total (hospital null, is_total 1), from one rollup."""
    sums = [F.sum(c).cast(MONEY).alias(c) for c in ("total", "insurance", "self_pay")]
    return details.rollup("hospital").agg(F.grouping("hospital").cast("int").alias("is_total"), F.count("*").alias("receipts"), *sums)


def fee_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Sum by type of positive numeric amounts (strings, commas allowed) with a type that is not blank."""
    amount = F.regexp_replace("amount", ",", "").try_cast("decimal(20,4)")
    # counted in the aggregate, as a filter on the type would be pushed below what derives it and derive it twice
    counts = F.when((F.col("amount") > 0) & (F.trim("fee_type") != ""), F.col("amount"))
    sums = items.withColumn("amount", amount).groupBy(*keys, "fee_type").agg(F.round(F.sum(counts), 2).cast(MONEY).alias("amount"), F.count(counts).alias("n_items"))
    return sums.where("n_items > 0")


def inpatient_pick(receipts: DataFrame, key: str = "case_id") -> DataFrame:
    """One receipt a case: the insured one of largest total, else the first that is not zero; the earlier one in a tie.

    receipts: key, seq (order), total, insurance.
    """
    insured = F.col("insurance") > 0
    rank = F.when(insured, F.struct(F.lit(2).alias("r"), F.col("total").alias("t"), (-F.col("seq")).alias("s"))).when(F.col("total") != 0, F.struct(F.lit(1).alias("r"), F.lit(0).cast(MONEY).alias("t"), (-F.col("seq")).alias("s")))
    return receipts.withColumn("_r", rank).where("_r is not null").groupBy(key).agg(F.max_by(F.struct("seq", "total", "insurance"), "_r").alias("p")).select(key, "p.*")


def death_years(age: Column, years: Column) -> Column:
    """Years that count: 5 from 75 on, one less than 20 for each year over 60, else as given or 20; without an age as given."""
    given = F.coalesce(years, F.lit(0))
    return (
        F.when(F.coalesce(age, F.lit(0)) <= 0, given)
        .when(age >= 75, 5)
        .when(age >= 60, F.greatest(20 - (age - 60), F.lit(5)))
        .otherwise(F.when(given > 0, given).otherwise(20))
    )


def compensation(params: DataFrame) -> DataFrame:
    """case_id, fee_type, amount and is_manual of every item of a case.

    params has one row a case: the columns of FIXTURES' parameters, and medical_total and
    supplies_total from receipts. A case that is not injury counts as death. Amounts are rounded half
    up at two places, or none for spiritual damage; division comes last.
    """
    zero = F.lit(0).cast(MONEY)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    money = lambda c: F.coalesce(F.col(c), zero)
    half = lambda c, d=2: F.round(c, d).cast(MONEY)
    nursing_days = F.when(n("nursing_days") > 0, F.col("nursing_days")).otherwise(n("hospital_days"))
    persons = F.greatest(n("nursing_person_count"), F.lit(1))
    level = F.when(F.col("nursing_dependency_level") == "mostly", F.lit(8)).when(F.col("nursing_dependency_level") == "partial", F.lit(5)).otherwise(F.lit(10))
    nursing = (money("nursing_annual_salary") * nursing_days * persons * level).cast("decimal(30,2)") / F.lit(3650)
    nutrition_days = F.when(n("nutrition_days") > 0, F.col("nutrition_days")).otherwise(n("hospital_days"))
    coefficient, years = F.coalesce("disability_coefficient", F.lit(0).cast("decimal(5,4)")), n("compensation_years")
    dependent = F.when((coefficient <= 0) & (n("victim_age") > 0), F.lit(1).cast("decimal(5,4)")).otherwise(coefficient)
    dead_years = death_years(F.col("victim_age"), F.col("compensation_years"))
    amounts = {
        "medical_fee": money("medical_total"),
        "lost_wages": F.when((n("lost_wage_days") > 0) & (money("monthly_salary") > 0), (money("monthly_salary") * n("lost_wage_days")).cast("decimal(30,2)") / 30).otherwise(zero),
        "nursing_fee": half(nursing) + money("supplies_total"),
        "food_subsidy": n("hospital_days") * money("daily_food_subsidy"),
        "nutrition_fee": nutrition_days * money("daily_nutrition"),
        "disability_compensation": F.when((coefficient > 0) & (years > 0), money("annual_income") * years * coefficient).otherwise(zero),
        "death_compensation": money("annual_income") * F.greatest(dead_years, F.lit(0)),
        "dependent_living": F.when((dependent > 0) & (years > 0), money("annual_consumption") * years * dependent).otherwise(zero),
        "funeral_fee": money("monthly_salary") * 6,
        "transport_fee": zero,
        "appraisal_fee": zero,
        "spiritual_damage": F.when(coefficient > 0, half(coefficient * 50000, 0)).otherwise(zero),
    }
    manual = {
        "medical_fee": money("medical_total") == 0,
        "lost_wages": ~((n("lost_wage_days") > 0) & (money("monthly_salary") > 0)),
        "nursing_fee": (nursing_days == 0) & (money("supplies_total") == 0),
        "food_subsidy": n("hospital_days") == 0,
        "nutrition_fee": nutrition_days == 0,
        "disability_compensation": ~((coefficient > 0) & (years > 0)),
        "death_compensation": dead_years <= 0,
        "dependent_living": ~((dependent > 0) & (years > 0)),
        "funeral_fee": F.lit(False),
        "transport_fee": F.lit(True),
        "appraisal_fee": F.lit(True),
        "spiritual_damage": coefficient <= 0,
    }
    item = lambda k: F.struct(F.lit(k).alias("fee_type"), half(amounts[k]).alias("amount"), manual[k].alias("is_manual"))
    rows = F.when(F.col("case_type") == "injury", F.array(*map(item, INJURY_ITEMS))).otherwise(F.array(*map(item, DEATH_ITEMS)))
    return params.select("case_id", F.explode(rows).alias("i")).select("case_id", "i.*")


def compensation_total(items: DataFrame) -> DataFrame:
    """Total by case of the manual amount (unless null or 0) or the computed one, without the dependants' living."""
    effective = F.coalesce(F.nullif(F.col("manual_amount"), F.lit(0).cast(MONEY)), F.col("amount"))
    return items.groupBy("case_id").agg(F.coalesce(F.sum(F.when(F.col("fee_type") != "dependent_living", effective)), F.lit(0)).cast(MONEY).alias("total"), F.count_if(F.nullif(F.col("manual_amount"), F.lit(0).cast(MONEY)).isNotNull()).alias("n_manual"))


