"""Files that arrive in a folder: each stable file exactly once, over restarts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from foliant.sources import watch as W


class Run:
    """A query over a folder; each trigger is one listing and one restart."""

    def __init__(self, spark, base: Path, archive: bool = False, checks: int = 2):
        self.spark, self.base, self.archive, self.checks = spark, base, archive, checks
        self.folder = base / "in"
        self.folder.mkdir()

    def trigger(self) -> None:
        stream = W.arrivals(self.spark, f"file://{self.folder}", f"file://{self.base}/archive" if self.archive else None, self.checks)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{self.base}/checkpoint")
        writer.trigger(availableNow=True).start(f"{self.base}/out").awaitTermination(120)

    def taken(self) -> list[tuple[str, bytes]]:
        rows = self.spark.read.schema(W.SCHEMA).parquet(f"{self.base}/out").collect()
        return sorted((Path(r.path).name, bytes(r.content)) for r in rows)


def test_files_that_grow_come_back_and_restarts(spark, tmp_path):
    run = Run(spark, tmp_path)
    (run.folder / "a.pdf").write_bytes(b"whole")
    (run.folder / "grows.PDF").write_bytes(b"1")
    (run.folder / "empty.pdf").write_bytes(b"")
    for other in ("~a.pdf", ".a.pdf", "b.txt"):
        (run.folder / other).write_bytes(b"no")
    run.trigger()
    assert run.taken() == []
    (run.folder / "grows.PDF").write_bytes(b"12")
    run.trigger()
    run.trigger()
    assert run.taken() == [("a.pdf", b"whole")]
    run.trigger()
    want = [("a.pdf", b"whole"), ("grows.PDF", b"12")]
    assert run.taken() == want
    (run.folder / "a.pdf").unlink()
    run.trigger()
    (run.folder / "a.pdf").write_bytes(b"again")
    (run.folder / "grows.PDF").write_bytes(b"12 and later more")
    for _ in range(4):
        run.trigger()
    assert run.taken() == sorted([*want, ("a.pdf", b"again")])


def test_taken_files_go_to_the_archive(spark, tmp_path):
    run = Run(spark, tmp_path, archive=True, checks=1)
    for body in (b"one", b"two"):
        (run.folder / "a.pdf").write_bytes(body)
        for _ in range(4):
            run.trigger()
        assert list(run.folder.iterdir()) == []
    assert run.taken() == [("a.pdf", b"one"), ("a.pdf", b"two")]
    assert sorted(p.read_bytes() for p in (tmp_path / "archive").iterdir()) == [b"one", b"two"]


def test_a_batch_that_is_run_again_reads_the_same_files(tmp_path):
    reader = W.FolderStream({"path": f"file://{tmp_path}", "checks": "1"})
    (tmp_path / "a.pdf").write_bytes(b"x")
    start = reader.latestOffset()
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    again = W.FolderStream({"path": f"file://{tmp_path}", "checks": "1"})
    assert again.partitions(start, end) == parts and again.latestOffset() == end
    assert [b.to_pylist()[0]["content"] for p in parts for b in reader.read(p)] == [b"x"]
    (tmp_path / "a.pdf").unlink()
    assert [b.to_pylist()[0]["content"] for p in parts for b in reader.read(p)] == [None]


@pytest.mark.parametrize("checks", [1, 2, 3])
def test_table_gives_what_the_stream_gives(spark, checks):
    rng = random.Random(checks)
    listings, offset, want = [], {"n": 0, "files": {}}, []
    sizes: dict[str, int] = {}
    for n in range(1, 120):
        for name in "abcdef":
            if rng.random() < 0.15:
                sizes.pop(name, None)
            elif rng.random() < 0.4:
                sizes[name] = rng.choice([0, 5, 5, 9])
        listings += [(n, name, length) for name, length in sizes.items()]
        offset_now = W.listed(offset, sizes, checks)
        offset_now = {**offset_now, "n": n}  # an unchanged folder leaves the offset alone, while a table counts on
        want += [(name, offset_now["files"][name][0], n, length) for name, length in W.newly_taken(offset, offset_now)]
        offset = offset_now
    got = W.appearances(spark.createDataFrame(listings, "n long, path string, length long"), checks).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20


def test_no_listings(spark):
    assert W.appearances(spark.createDataFrame([], "n long, path string, length long")).collect() == []
