"""Window forms against plain folds, and rules at their edges."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliant.operators import casework, fees, fusion, structure, tenancy
from foliant.streaming import events


def test_islands_equal_a_fold(spark):
    rng = random.Random(1)
    rows = [(d, 0, i, f"t{i}", 50, rng.randrange(300), rng.randrange(3000), 10, rng.randrange(5, 60)) for d in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, conf int, x int, y int, w int, h int")
    got = {(r.doc_id, r.para): r.n_lines for r in structure.paragraphs(df).collect()}
    want: dict = {}
    for d in range(20):
        bottom, para = None, 0
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[6], r[5], r[2])):
            if bottom is None or r[6] - bottom > 80:
                para, bottom = para + 1, r[6] + r[8]
            bottom = max(bottom, r[6] + r[8])
            want[d, para] = want.get((d, para), 0) + 1
    assert got == want


def test_section_tree_equals_a_stack(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.randrange(1, 6)) for d in range(10) for i in range(25)]
    got = {(r.doc_id, r.idx): (r.parent, r.depth) for r in structure.section_tree(spark.createDataFrame(rows, "doc_id long, idx int, level int")).collect()}
    for d in range(10):
        stack: list = []
        for _, i, level in [r for r in rows if r[0] == d]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, i] == (stack[-1][0] if stack else None, len(stack) + 1)
            stack.append((i, level))


def test_repeated_lines_need_three_pages(spark):
    lines = [(d, p, i, t, y) for d, n in ((1, 4), (2, 2)) for p in range(n) for i, (t, y) in enumerate([("Head", 10), (f"body {p}", 900), (str(p + 1), 3400)])]
    out = structure.without_repeated_lines(spark.createDataFrame(lines, "doc_id long, page int, idx int, text string, y int"))
    kept = sorted((r.doc_id, r.text) for r in out.collect())
    assert [t for d, t in kept if d == 1] == [f"body {p}" for p in range(4)]
    assert len([t for d, t in kept if d == 2]) == 6


def test_lists_fold(spark):
    texts = ["1. one", "goes on", "2. two", "prose ends.", "a) x", "b) y", "1. alone"]
    rows = [(1, i, t, 90, 100) for i, t in enumerate(texts)]
    got = structure.lists(spark.createDataFrame(rows, "doc_id long, idx int, text string, conf int, x int")).collect()
    assert [(r.type, r.n_items, r.markers, r.content) for r in got] == [("numbered_arabic", 2, "1|2", "one goes on|two"), ("lettered_lower", 2, "a|b", "x|y")]


@pytest.mark.parametrize(("age", "years", "want"), [(0, 0, 0), (0, 7, 7), (59, 0, 20), (59, 9, 9), (60, 3, 20), (74, 3, 6), (75, 3, 5), (99, 0, 5), (None, None, 0)])
def test_death_years(spark, age, years, want):
    row = spark.createDataFrame([(age, years)], "a int, y int").select(fees.death_years(F.col("a"), F.col("y")).alias("x")).first()
    assert row.x == want


def test_compensation_of_an_injury(spark):
    columns = "case_id long, case_type string, annual_income decimal(18,2), annual_consumption decimal(18,2), monthly_salary decimal(18,2), nursing_annual_salary decimal(18,2), daily_food_subsidy decimal(18,2), daily_nutrition decimal(18,2), compensation_years int, disability_coefficient decimal(5,4), hospital_days int, lost_wage_days int, nursing_days int, nutrition_days int, nursing_dependency_level string, nursing_person_count int, victim_age int, medical_total decimal(18,2), supplies_total decimal(18,2)"
    D = Decimal
    row = (1, "injury", D("49283"), D("33382"), D("8500"), D("102000"), D("100"), D("30"), 20, D("0.3"), 10, 7, 0, 0, "partial", 0, 40, D("1234.50"), None)
    got = {r.fee_type: (r.amount, r.is_manual) for r in fees.compensation(spark.createDataFrame([row], columns)).collect()}
    assert len(got) == len(fees.INJURY_ITEMS)
    assert got["lost_wages"] == (D("1983.33"), False)
    assert got["nursing_fee"] == (D("1397.26"), False)
    assert got["disability_compensation"] == (D("295698.00"), False)
    assert got["spiritual_damage"] == (D("15000.00"), False)
    assert got["nutrition_fee"] == (D("300.00"), False)
    assert got["transport_fee"] == (D("0.00"), True)


def test_inpatient_pick_equals_the_rule(spark):
    rows = [(1, 1, Decimal("50"), Decimal("0")), (1, 2, Decimal("10"), Decimal("5")), (1, 3, Decimal("10"), Decimal("7")), (2, 1, Decimal("0"), Decimal("0")), (2, 2, Decimal("9"), Decimal("0")), (2, 3, Decimal("99"), Decimal("0"))]
    got = {r.case_id: r.seq for r in fees.inpatient_pick(spark.createDataFrame(rows, "case_id long, seq long, total decimal(18,2), insurance decimal(18,2)")).collect()}
    assert got == {1: 2, 2: 2}


def test_classification(spark):
    rows = [(1, "injury", "a.pdf", "死亡证明 死亡诊断"), (2, "death", "a.pdf", "死亡证明 死亡诊断"), (3, "injury", "身份证正面.jpg", ""), (4, "injury", "", None), (5, "injury", "x", "CT报告 住院 病历")]
    got = {r.id: (r.category, r.confidence) for r in casework.classified(spark.createDataFrame(rows, "id int, case_type string, filename string, ocr_text string")).collect()}
    assert got[1] == ("other_evidence", 0.3)
    assert got[2] == ("death_certificate", 0.7)
    assert got[3] == ("identity_id_card", 0.5)
    assert got[4] == ("other_evidence", 0.0)
    assert got[5] == ("medical_record", 0.75)


def test_last_resort_is_capped(spark):
    pages = spark.createDataFrame([(1, p, 10.0 if p != 2 else 90.0) for p in range(6)], "case_id long, page int, confidence double")
    assert [r.page for r in fusion.last_resort(pages).where("fallback").orderBy("page").collect()] == [0, 1, 3]


def test_running_count_floors_at_zero(spark):
    changes = [-1, 1, 1, -1, -1, -1, 1, 1, 1, 1]
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate(changes)], "key string, seq long, change long")
    used, want = 0, []
    for c in changes:
        used = max(0, used + c)
        want.append(used)
    assert [r.used for r in events.running(df, 10).orderBy("seq").collect()] == want


def test_paging_bounds(spark):
    df = spark.range(10).selectExpr("id", "id % 2 AS created_at")
    assert [r.id for r in tenancy.listed(df, "nope", ("id",), page=0, size=0).collect()] == [1]
    assert tenancy.listed(df, "id", ("id",), page=1, size=500).count() == 10


def test_context_packing_equals_a_plain_fold(spark):
    rng = random.Random(4)
    kinds = ("死亡诊断", "诊断", "其他")
    rows = [(d, i, rng.choice(kinds) + "x" * rng.choice((0, 5, 40, 90, 200))) for d in range(12) for i in range(rng.randrange(1, 14))]
    got = sorted(tuple(r) for r in casework.packed_context(spark.createDataFrame(rows, "doc_id long, idx int, text string"), 300).collect())
    want = []
    for d in range(12):
        left, place = 300, 0
        for kind in kinds:
            for _, i, text in sorted(r for r in rows if r[0] == d and r[2].startswith(kind)):
                if len(text) <= left:
                    want.append((d, place, i, len(text)))
                    left, place = left - len(text), place + 1
                    continue
                if left > 50:
                    want.append((d, place, i, left))
                    left, place = 0, place + 1
                break
    assert got == sorted(want)


@pytest.mark.parametrize("sizes", [(1, 1, 1, 1), (2, 1, 1, 2), (1, 3, 1, 1)])
def test_emptied_pages_take_nothing_in(spark, sizes):
    """All lines run on: pages of one line that were taken in do not take the next page's first line in."""
    rows, idx = [], 0
    for page, n in enumerate(sizes):
        for _ in range(n):
            rows.append((1, page, idx, f" line {idx} ", 50 + idx))
            idx += 1
    pages = [[[i, t, float(c)] for _, p, i, t, c in rows if p == page] for page in range(len(sizes))]
    for a, b in zip(pages, pages[1:]):
        if a and b:
            first = b.pop(0)
            a[-1][1] += first[1].strip()
            a[-1][2] = round((a[-1][2] + first[2]) / 2, 4)
    got = structure.cross_page_merged(spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, conf int")).orderBy("idx").collect()
    assert [(r.idx, r.text, r.confidence) for r in got] == [tuple(x) for p in pages for x in p]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_packing_shuffles_lengths_and_folds_no_document_in_python(spark):
    rows = [(1, 0, "诊断 " + "x" * 150), (1, 1, None), (1, 2, "死亡诊断" + "y" * 60), (1, 3, "z" * 300), (1, 4, "z"), (2, 0, "")]
    packed = casework.packed_context(spark.createDataFrame(rows, "doc_id long, idx int, text string"), 300)
    assert sorted(tuple(r) for r in packed.collect()) == [(1, 0, 2, 64), (1, 1, 0, 153), (1, 2, 1, 0), (1, 3, 3, 83), (2, 0, 0, 0)]
    assert "InPandas" not in _plan(packed) and "InArrow" not in _plan(packed)


def test_lists_stream_through_a_task_and_take_gaps(spark):
    lines = [(d, i, t, 50 + i, 100) for d in range(300) for i, t in enumerate(("1. a", "goes on", "2. b", "", "1. lone", "Ends it.", "- x", "- y"))]
    found = structure.lists(spark.createDataFrame(lines, "doc_id long, idx int, text string, conf int, x int").repartition(3))
    got = sorted((r.doc_id, r.list, r.type, r.n_items, r.content, r.confidence) for r in found.collect())
    assert got == [x for d in range(300) for x in ((d, 0, "numbered_arabic", 2, "a goes on|b", 51.0), (d, 1, "bulleted", 2, "x|y", 56.5))]
    assert "FlatMapGroups" not in _plan(found)


def test_amounts_by_labels_look_for_each_sum_once(spark):
    texts = ["合计金额：1,000.5元", "合计\n77.10", "9.5\n个人负担金额", "医疗保障结算单\n12\n医疗费总额\n合计：3\n统筹支付：5", "合计：x\n4\n合计", "合计,", "合计：,", "无", "", None]
    from foliant.operators import fees

    out = fees.receipt_amounts(spark.createDataFrame(list(enumerate(texts)), "material_id long, t string"))
    got = {r.material_id: (r.amount, r.insurance, r.self_pay) for r in out.collect()}
    assert got == {0: (1000.5, 0.0, 0.0), 1: (77.1, 0.0, 0.0), 2: (0.0, 0.0, 9.5), 3: (12.0, 5.0, 7.0), 4: (4.0, 0.0, 0.0), **{k: (0.0, 0.0, 0.0) for k in range(5, 10)}}
    # one pattern for each of the 14 labels, whatever their sums are used for
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 14


def test_numbers_and_days_are_only_cast_where_they_can_be(spark):
    from foliant.functions import text as T

    numbers = ["1.5", " -2", "n/a", "x", "", None, "NaN", "1e3", ".5", "+7d", "1x", "-Infinity", "\t3"]
    df = spark.createDataFrame([(x,) for x in numbers], "c string").select("c", T.double_or_null(F.col("c")).alias("got"), F.col("c").try_cast("double").alias("want"))
    assert all(str(r.got) == str(r.want) for r in df.collect())
    days = ["2024-02-29", "2023-02-29", "2024-02-30", "2024-13-01", "2024-1-01", "", None, "2024-04-31", "2024-12-31", "20240101", "2024-00-10"]
    df = spark.createDataFrame([(x,) for x in days], "c string").select("c", T.iso_day(F.col("c")).alias("got"), F.try_to_date("c", "yyyy-MM-dd").alias("want"))
    assert all(r.got == r.want for r in df.collect())


def test_defendants_read_materials_once(spark):
    from foliant.operators import extraction

    rows = [(1, 1, "medical_record", "a.pdf", "被告中山市第一人民医院"), (1, 2, "identity_defendant", "b.pdf", "张三与北京第一医院（协和医院）"), (2, 1, "other_evidence", "a.pdf", "被告中山人民医院"), (3, 1, "appraisal", None, None)]
    out = extraction.defendants(spark.createDataFrame(rows, "case_id long, material_id long, category string, filename string, ocr_text string"))
    assert [(r.case_id, r.defendant_name) for r in out.collect()] == [(1, "北京第一医院（协和医院）")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
