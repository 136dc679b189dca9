"""Compensation items with the words of their calculation, and the empty form of a case without figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The items of a form by type of case with how each is found, shares by degree of dependency, and ages from which a
# death is compensated for fewer years.
COMMON = (
    ("医疗费", "凭票据实报实销"),
    ("误工费", "误工收入 × 误工天数（参照鉴定意见）"),
    ("护理费", "住院期间护理费 = 护理标准 × 住院天数"),
    ("住院伙食补助费", "住院伙食补助标准 × 住院天数"),
    ("营养费", "营养费标准 × 营养期天数（参照鉴定意见）"),
)
FORMS = {
    "death": (*COMMON, ("死亡赔偿金", "受诉法院所在地上年度城镇居民人均可支配收入 × 20年（含被扶养人生活费）"), ("丧葬费", "受诉法院所在地上年度职工月平均工资 × 6个月"), ("交通费", "凭票据实报实销"), ("精神损害抚慰金", "根据死亡后果酌定")),
    "injury": (*COMMON, ("残疾赔偿金", "受诉法院所在地上年度城镇居民人均可支配收入 × 20年 × 伤残系数（含被扶养人生活费）"), ("后续治疗费", "参照鉴定意见或后续实际发生费用"), ("交通费", "凭票据实报实销"), ("精神损害抚慰金", "根据伤残等级酌定")),
}
DEPENDENCE = {"full": "完全护理依赖(100%)", "mostly": "大部分护理依赖(80%)", "partial": "部分护理依赖(50%)"}
FULL_YEARS, LEAST_YEARS, OLD, VERY_OLD = 20, 5, 60, 75


def form(cases: DataFrame) -> DataFrame:
    """case_id, place (from 0), item and basis of the empty form of each case (case_id, case_type; all but death count as injury)."""
    lists = {k: F.array(*[F.struct(F.lit(item).alias("item"), F.lit(basis).alias("basis")) for item, basis in rows]) for k, rows in FORMS.items()}
    rows = cases.select("case_id", F.posexplode(F.when(F.col("case_type") == "death", lists["death"]).otherwise(lists["injury"])).alias("place", "row"))
    return rows.select("case_id", "place", "row.item", "row.basis")


def _whole(c: str) -> Column:
    """A number without its fraction, rounded, as text."""
    return F.round(F.col(c).cast("decimal(18,2)"), 0).cast("long").cast("string")


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def death_years() -> Column:
    """Years that a death is compensated for: full ones below sixty, one less for each year above, five from seventy-five on."""
    age, years = F.col("victim_age"), F.col("compensation_years")
    below = F.when(years > 0, years).otherwise(FULL_YEARS)
    return F.when(age >= VERY_OLD, LEAST_YEARS).when(age >= OLD, F.greatest(FULL_YEARS - (age - OLD), F.lit(LEAST_YEARS))).when(age > 0, below).otherwise(years)


def bases(params: DataFrame, name: Column | None = None) -> DataFrame:
    """params (columns of records.params_of()) with a text for each item whose calculation is spelled out; null where there is nothing to calculate.

    name: the plaintiff (null or empty: 原告).
    """
    who = F.coalesce(F.nullif(name, F.lit("")), F.lit("原告")) if name is not None else F.lit("原告")
    days = lambda c: F.col(c).cast("string")
    nursing_days = F.when(F.col("nursing_days") > 0, F.col("nursing_days")).otherwise(F.col("hospital_days"))
    persons = F.col("nursing_person_count")
    dependence = F.coalesce("nursing_dependency_level", F.lit("full"))
    label = F.coalesce(*[F.when(dependence == k, v) for k, v in DEPENDENCE.items()], F.lit(""))
    supported = lambda amount: F.when(F.col("annual_consumption") > 0, _text("（含被扶养人生活费 ¥", amount.cast("decimal(18,2)").cast("string"), "）")).otherwise("")
    coefficient = F.col("disability_coefficient").cast("double")
    years = death_years()
    found = {
        "nursing_fee": (nursing_days > 0, _text(who, "共住院治疗", nursing_days.cast("string"), "天，其护理费按上一年度居民服务、修理和其他服务业非私营单位在岗职工年平均工资", _whole("nursing_annual_salary"), "元/年计算：", _whole("nursing_annual_salary"), "元/年÷365天×", nursing_days.cast("string"), "天", F.when(persons > 1, _text("× ", persons.cast("string"), "人")).otherwise(""), F.when(dependence != "full", _text("× ", label)).otherwise(""))),
        "lost_wages": (F.col("lost_wage_days") > 0, _text(who, "的误工费按上一年度职工月平均工资", _whole("monthly_salary"), "元/月计算：", _whole("monthly_salary"), "元/月÷30天×", days("lost_wage_days"), "天")),
        "food_subsidy": (F.col("hospital_days") > 0, _text(who, "共住院治疗", days("hospital_days"), "天，按", _whole("daily_food_subsidy"), "元/天计算：", _whole("daily_food_subsidy"), "元/天×", days("hospital_days"), "天")),
        "nutrition_fee": (F.col("hospital_days") > 0, _text(who, "共住院治疗", days("hospital_days"), "天，按", _whole("daily_nutrition"), "元/天计算：", _whole("daily_nutrition"), "元/天×", days("hospital_days"), "天")),
        "disability_compensation": (F.col("compensation_years") > 0, _text("按上一年度城镇居民人均可支配收入", _whole("annual_income"), "元/年×", days("compensation_years"), "年×伤残系数", coefficient.cast("string"), supported(F.col("annual_consumption") * F.col("compensation_years") * F.col("disability_coefficient")))),
        "death_compensation": (years > 0, _text("按上一年度城镇居民人均可支配收入", _whole("annual_income"), "元/年×", years.cast("string"), "年", supported(F.col("annual_consumption") * years))),
        "funeral_fee": (F.lit(True), _text("按上一年度职工月平均工资", _whole("monthly_salary"), "元/月，以六个月总额计算：", _whole("monthly_salary"), "元/月×6月")),
    }
    return params.withColumns({f"{k}_basis": F.when(there, text) for k, (there, text) in found.items()})
