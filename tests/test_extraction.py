from __future__ import annotations

import pytest

from foliant.functions import generators
from foliant.operators import extraction as X
from foliant.sources import ingest

PAPER = "case_id long, material_id long, category string, filename string, ocr_text string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("死亡诊断：①呼吸衰竭；②休克；③感染①心电图异常", "①呼吸衰竭；②休克；③感染"),
        ("死亡诊断：1.肺炎\n2.休克\n", "1.肺炎；2.休克"),
        ("死亡原因：多器官功能衰竭；脓毒症休克；急性肾损伤。", "多器官功能衰竭；脓毒症休克；急性肾损伤"),
        ("死因分析: 患者因大出血死亡。后文", "患者因大出血死亡"),
        ("无关文字", None),
    ],
)
def test_death_diagnosis_forms(spark, text, want):
    rows = X.death_diagnosis(spark.createDataFrame([(1, 1, "medical_record", "a", text)], PAPER)).collect()
    assert (rows[0].death_diagnosis if rows else None) == want


def test_death_diagnosis_prefers_appraisals_and_labels(spark):
    rows = [
        (1, 1, "death_certificate", "a", "死亡诊断：休克与感染"),
        (1, 2, "appraisal", "a", "鉴定意见：因呼吸衰竭死亡"),
        (2, 1, "medical_record", "a", "出院诊断：肺炎；多器官功能衰竭"),
        (2, 2, "other", "a", "死亡诊断：不算数的材料"),
        (3, 1, "medical_record", "a", None),
    ]
    got = {r.case_id: r.death_diagnosis for r in X.death_diagnosis(spark.createDataFrame(rows, PAPER)).collect()}
    assert got == {1: "因呼吸衰竭死亡", 2: "多器官功能衰竭"}


def test_defendant_name_is_cut_and_longest(spark):
    rows = [(1, 1, "medical_record", "a", "被告中山医院"), (1, 2, "identity_defendant", "a", "某甲与中山市人民医院（中山医院）\n地址\n广东中山市幸福路3号"), (2, 1, "other", "a", "被告中山医院")]
    got = X.defendants(spark.createDataFrame(rows, PAPER)).collect()
    assert [(r.case_id, r.defendant_name, r.defendant_address) for r in got] == [(1, "中山市人民医院（中山医院）", "广东中山市幸福路3号")]


def test_generator_code():
    assert generators.violations("def generate(x):\n    return {'a': x['b']}") == []
    assert generators.violations("import os.path\nfrom subprocess import run\nopen('x')\n().__class__") == ["import os.path", "import subprocess", "call open", "attribute __class__"]
    assert generators.violations("def (") == ["syntax"]
    assert generators.violations("#" * 300_000) == ["size"]


def test_registered_generator(spark):
    generators.register(spark, "twice", lambda x: x * 2, "long", "lambda x: x * 2")
    assert spark.sql("SELECT twice(CAST(4 AS BIGINT)) AS x").first().x == 8
    with pytest.raises(ValueError, match="call eval"):
        generators.register(spark, "bad", lambda x: x, "long", "eval('1')")


def test_watched_folder(spark, tmp_path):
    for name in ("a.pdf", "~b.pdf", ".c.pdf", "d.PDF", "e.txt"):
        (tmp_path / name).write_bytes(b"%PDF-1.4 x")
    rows = ingest.folder(spark, str(tmp_path)).select(ingest.magic_kind("content").alias("k")).collect()
    assert [r.k for r in rows] == ["pdf", "pdf"]
    query = ingest.folder(spark, str(tmp_path), streaming=True).select("path").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_no_plaintiff_is_lost_in_numbered_columns(spark):
    rows = [(1, 10 + i, f"p{i}") for i in range(5)] + [(2, 3, "q")]
    wide = X.numbered_columns(spark.createDataFrame(rows, "case_id long, seq long, name string"))
    assert wide.columns == ["case_id", "name_1", "name_2", "name_3", "more_names"]
    assert {r.case_id: r.more_names for r in wide.collect()} == {1: ["p3", "p4"], 2: []}
    back = X.numbered_rows(wide).orderBy("case_id", "seq").collect()
    assert [(r.case_id, r.name) for r in back] == [(1, f"p{i}") for i in range(5)] + [(2, "q")]


def test_generated_documents(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}"), (3, None)], "id long, data string")
    code = "def generate(data):\n    return 'a' + str(data['a'])"
    with pytest.raises(ValueError, match="trusted"):
        generators.generated(rows, code)
    with pytest.raises(ValueError, match="import os"):
        generators.generated(rows, "import os", trusted=True)
    got = {r.id: (r.document, r.error) for r in generators.generated(rows, code, trusted=True).collect()}
    assert got == {1: ("a1", None), 2: (None, "KeyError: 'a'"), 3: (None, "KeyError: 'a'")}
    assert {r.id: r.document for r in generators.generated(rows).collect()} == {1: '{\n  "a": 1\n}', 2: "{}", 3: "{}"}
    escaping = "def generate(data):\n    return str(open)"
    assert generators.generated(rows.limit(1), escaping, trusted=True).first().error.startswith("NameError")
