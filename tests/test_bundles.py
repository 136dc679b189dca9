"""One container a case: members equal the rows, failures are rows, attempts leave nothing behind."""

from __future__ import annotations

import random
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest

from foliant.sources import bundles as B

SCHEMA = "container string, member string, content binary, error string"


def rows_of(spark, path):
    return sorted(((r.container, r.member, None if r.content is None else bytes(r.content), r.error) for r in B.read_bundles(spark, f"file://{path}").collect()), key=str)


def test_members_equal_the_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"案件{c}", f"0{m}_目录/{m}.txt", rng.randbytes(rng.randrange(2000)), None) for c in range(30) for m in range(rng.randrange(1, 8))]
    rng.shuffle(rows)
    B.write_bundles(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/out")
    assert rows_of(spark, tmp_path / "out") == sorted(rows, key=str)
    files = list((tmp_path / "out").rglob("*.zip"))
    assert len(files) == 30 and {p.stem for p in files} == {r[0] for r in rows}
    assert not list((tmp_path / "out").glob("_*"))
    with zipfile.ZipFile(files[0]) as z:
        assert z.testzip() is None


def test_failures_do_not_fail_the_case(spark, tmp_path):
    rows = [
        ("a", "good.txt", b"1", None), ("a", "made.pdf", None, "TEMPLATE_MISSING"), ("a", "none.txt", None, None), ("a", "../out.txt", b"x", None), ("a", "/root.txt", b"x", None),
        ("a", None, b"x", None), ("a", "twice.txt", b"1", None), ("a", "twice.txt", b"2", None), ("b/c", "only.txt", None, "BROKEN"), ("d", "empty.txt", b"", None), (None, "x", b"x", None),
    ]
    B.write_bundles(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/out")
    got = rows_of(spark, tmp_path / "out")
    assert [g for g in got if g[3] is None and g[1] != "twice.txt"] == [("a", "good.txt", b"1", None), ("d", "empty.txt", b"", None)]
    assert len([g for g in got if g[1] == "twice.txt" and g[3] is None]) == 1
    failed = {(g[0], g[1], g[3]) for g in got if g[3]}
    assert failed == {("a", "made.pdf", "TEMPLATE_MISSING"), ("a", "none.txt", "NO_CONTENT"), ("a", "../out.txt", "UNSAFE_NAME"), ("a", "/root.txt", "UNSAFE_NAME"), ("a", "", "UNSAFE_NAME"), ("a", "twice.txt", "REPEATED_NAME"), ("b/c", "only.txt", "BROKEN")}
    assert len(list((tmp_path / "out").rglob("*.zip"))) == 3


def test_overwrite_append_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    one, two = [("a", "1", b"1", None)], [("b", "1", b"2", None), ("b", "2", None, "E")]
    B.write_bundles(spark.createDataFrame(one, SCHEMA), path)
    B.write_bundles(spark.createDataFrame(two, SCHEMA), path)
    assert rows_of(spark, tmp_path / "out") == sorted([*one, *two], key=str)
    B.write_bundles(spark.createDataFrame(one, SCHEMA), path, "overwrite")
    assert rows_of(spark, tmp_path / "out") == one
    B.write_bundles(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert rows_of(spark, tmp_path / "none") == []


def _batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(("container", "member", "content", "error"), r)) for r in rows], pa.schema([("container", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())]))


def test_a_second_attempt_leaves_no_second_container(tmp_path, monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(B, "TaskContext", Task)
    writer = B.BundleWriter({"path": f"file://{tmp_path}"}, False)
    rows = [("a", "x", b"1", None), ("a", "y", None, "E"), ("b", "x", b"2", None)]

    def dies():
        yield _batch(rows)
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.write(iter([_batch(rows)]))  # an attempt that was not committed
    second = writer.write(iter([_batch(rows[:1]), _batch(rows[1:])]))
    assert not list(tmp_path.glob("part-*"))
    writer.commit([None, second])
    assert sorted(p.name for p in tmp_path.rglob("*.zip")) == ["a.zip", "b.zip"]
    assert not list(tmp_path.glob(f"{B.DRAFTS}*"))
    again = B.BundleWriter({"path": f"file://{tmp_path}"}, False)
    message = again.write(iter([_batch([("z", "1", b"1", None)])]))
    again.abort([message])
    assert sorted(p.name for p in Path(tmp_path).rglob("*.zip")) == ["a.zip", "b.zip"]


def test_small_containers_share_files_and_failures_stay_with_the_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"案件{c}", f"{m}.txt", rng.randbytes(rng.randrange(40, 90)), None) for c in range(200) for m in range(3)] + [("large", f"{m}.bin", rng.randbytes(B.PACKED // 2), None) for m in range(4)]
    failed = [(f"案件{c}", "x.pdf", None, "TEMPLATE_MISSING") for c in range(0, 200, 2)] + [("only", "x.pdf", None, "TEMPLATE_MISSING")]
    B.write_bundles(spark.createDataFrame([*rows, *failed], SCHEMA).repartition(5), f"file://{tmp_path}/out", packed=True)
    assert rows_of(spark, tmp_path / "out") == sorted([*rows, *failed], key=str)
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert [p.name for p in files if p.suffix == ".zip"] == ["large.zip"] and len(files) <= 3 * 4
    assert "failures" not in B.Written.__dataclass_fields__
