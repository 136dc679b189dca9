"""The model slot: who reaches it, in what batches, and what stands when it fails."""

from __future__ import annotations

import random

import pytest

from foliant.operators import slot as S

SCHEMA = "material_id long, case_type string, filename string, ocr_text string"
UNSURE = "没有关键词的文字"
SURE = "出院记录 住院 诊断证明 患者：李四"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def failing(bad, log=None):
    """An engine that raises for batches with one of the bad ids."""

    def engine_of():
        def engine(items):
            if any(i["material_id"] in bad for i in items):
                raise RuntimeError("429")
            return [{"category": "appraisal", "confidence": 0.876, "extracted": {"patient_name": f"n{i['material_id']}", "total_amount": 5}} for i in items]

        return engine

    return engine_of


def test_only_unsure_rows_reach_python(spark):
    rows = S.ruled(frame(spark, [(1, "injury", "a.pdf", SURE), (2, "injury", "a.pdf", UNSURE), (3, "injury", "a.pdf", "  "), (4, "injury", "a.pdf", None)]))
    by_id = {r.material_id: r for r in rows.collect()}
    assert by_id[1].sure and not by_id[2].sure and by_id[3].blank and by_id[4].category == "other_evidence" and by_id[4].confidence == 0.1
    seen = spark.sparkContext.accumulator(0)

    def engine_of():
        def engine(items):
            seen.add(len(items))
            return [{} for _ in items]

        return engine

    out = {r.material_id: r for r in S.with_model(rows, engine_of).collect()}
    assert seen.value == 1 and out[2].answered_by == "model" and out[1].answered_by == out[3].answered_by == out[4].answered_by == "rules"
    assert (out[2].category, out[2].confidence) == ("other_evidence", 0.5)
    plan = S.with_model(rows, engine_of)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "Filter" in below and "NOT" in below.split("Scan")[0].upper()


def test_failures_fall_back_to_single_calls_then_to_the_rules(spark):
    rows = S.ruled(frame(spark, [(i, "injury", "a.pdf", UNSURE) for i in range(23)]).coalesce(1))
    out = {r.material_id: r for r in S.with_model(rows, failing({3, 11}), tries=2).collect()}
    assert len(out) == 23
    for i, r in out.items():
        if i in (3, 11):
            assert (r.answered_by, r.category, r.calls, r.patient_name) == ("rules, no answer", "other_evidence", 3, None)
        else:
            assert (r.answered_by, r.category, r.confidence, r.patient_name, r.total_amount) == ("model", "appraisal", 0.88, f"n{i}", 5.0)
            assert r.calls == (2 if i < 5 or 10 <= i < 15 else 1)


@pytest.mark.parametrize("answer", [None, "text", {"confidence": "high"}, {"confidence": None}])
def test_answers_that_are_none(answer):
    item = {"material_id": 1, "text": "t", "case_type": "injury", "categories": S.categories("injury")}
    assert S.asked(lambda items: [answer] * len(items), [item], 1) == [(None, 2)]
    assert S.asked(lambda items: [], [item], 0) == [(None, 1)]


def test_answers_are_kept_within_bounds():
    allowed = S.categories("injury")
    assert S.checked({"category": "death_certificate", "confidence": 0.9}, allowed) == ("other_evidence", 0.3, {})
    assert S.checked({"category": "death_certificate", "confidence": 7}, S.categories("death")) == ("death_certificate", 1.0, {})
    assert S.checked({"category": "appraisal", "extracted": None}, allowed) == ("appraisal", 0.5, {})


def test_batches_of_five_over_all_frames(spark):
    rows = S.ruled(frame(spark, [(i, "injury", "a.pdf", UNSURE) for i in range(57)]).coalesce(1))
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def engine_of():
        def engine(items):
            assert len(items) <= 5
            sizes.add(len(items))
            calls.add(1)
            return [{"category": "appraisal"}] * len(items)

        return engine

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        assert S.with_model(rows, engine_of).where("answered_by = 'model'").count() == 57
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (sizes.value, calls.value) == (57, 12)


def test_without_an_engine_the_rules_stand(spark):
    rng = random.Random(1)
    rows = S.ruled(frame(spark, [(i, "injury", "a.pdf", rng.choice([SURE, UNSURE, ""])) for i in range(30)]))
    want = {r.material_id: (r.category, r.confidence, "rules" if r.sure else "rules, unsure") for r in rows.collect()}
    got = {r.material_id: (r.category, r.confidence, r.answered_by) for r in S.with_model(rows).collect()}
    assert got == want and S.with_model(S.ruled(frame(spark, []))).collect() == []


def test_a_filter_does_not_run_the_rules_again(spark):
    """A filter on sure stays above what computes it, so that the rules are not run for the filter as well."""
    rows = S.ruled(frame(spark, [(i, "injury", "a.pdf", UNSURE) for i in range(100)]).coalesce(1))
    plan = rows.where("not sure")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert plan.count("best_score(") == rows._jdf.queryExecution().optimizedPlan().toString().count("best_score(")
