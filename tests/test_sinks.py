from __future__ import annotations

import json

import pytest

from foliant.operators import report
from foliant.sources import sinks


def test_nested_sections(spark):
    tree = [(1, 0, "A", 1, None, 1), (1, 2, "B", 2, 0, 2), (1, 4, "C", 3, 2, 3), (1, 6, "D", 2, 0, 2), (1, 8, "E", 1, None, 1), (2, 0, "F", 2, None, 1)]
    texts = [(1, 0, 1, "a"), (1, 4, 5, "c2"), (1, 4, 4, "c1"), (2, 0, 1, "f")]
    out = sinks.nested_sections(spark.createDataFrame(tree, "doc_id long, idx int, title string, level int, parent int, depth int"), spark.createDataFrame(texts, "doc_id long, section int, idx int, text string"))
    got = {r.doc_id: json.loads(r.sections) for r in out.collect()}
    assert [s["title"] for s in got[1]] == ["A", "E"]
    assert [s["title"] for s in got[1][0]["subsections"]] == ["B", "D"]
    assert got[1][0]["subsections"][0]["subsections"][0]["paragraphs"] == ["c1", "c2"]
    assert got[2][0]["paragraphs"] == ["f"] and got[2][0]["subsections"] == []


def test_json_drops_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "id int, a string, b string")
    got = {r.id: r.document for r in sinks.as_json(df, "id", ["a", "b"]).collect()}
    assert got == {1: '{"b":"x"}', 2: '{"a":"y"}'}


def test_cascade_and_quarantine(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "a"), (2, "b")], "task_id int, f string")
    left, below = sinks.without_cascade(parents, children, spark.createDataFrame([(2,)], "id int"), "id", "task_id")
    assert [r.id for r in left.collect()] == [1] and [r.f for r in below.collect()] == ["a"]
    good, bad = sinks.split_valid(spark.createDataFrame([("a.pdf", None), ("b.pdf", "EMPTY_FILE")], "name string, error_code string"))
    assert good.count() == 1 and bad.first().quarantined_as == "EMPTY_FILE_b.pdf"


def test_bundle_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "catalog", "x"), (1, "fees", "y")], "case_id int, doc_type string, body string")
    sinks.bundled(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "case_id=1").iterdir()) == ["doc_type=catalog", "doc_type=fees"]
    df.write.parquet(str(tmp_path / "in"))
    sent = []
    query = sinks.to_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda batch, n: sent.append(batch.count()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sum(sent) == 2


@pytest.mark.parametrize(("numbers", "kept"), [([1, 2, 3, 1, 2], [1, 2, 3]), ([1, 1, 2], [1, 1, 2]), ([3, 3, 4], [3]), ([5], [5])])
def test_circled_run(spark, numbers, kept):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(numbers)], "doc_id int, pos int, number int")
    assert [r.number for r in report.circled_run(df).orderBy("pos").collect()] == kept
