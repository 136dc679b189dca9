"""A watched folder as a streaming data source: each file once, when it has stopped growing.

A listing of the folder is one offset. The offset holds what the folder holds: of each file the
listing at which it appeared, its size, how often the size has been the same since, and whether it
has been taken. So a restart from a checkpoint goes on with the files in flight, and a batch that is
run again reads the same files, which follow from its two offsets alone. A name that goes away and
comes back is a new file. With an archive folder, files whose batch is committed are moved there.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Times that a file's size has to be found unchanged (fixed value).
CHECKS = 2
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20
SCHEMA = "path string, modified timestamp, length long, content binary"
#: Names that are taken: neither hidden nor temporary, of this kind.
NAMES = r"[^~.].*\.pdf"


@dataclass
class Taken(InputPartition):
    files: tuple[tuple[str, int], ...]


def listed(before: dict, sizes: dict[str, int], checks: int = CHECKS, archived: bool = False) -> dict:
    """The offset after a listing: {"n": its number, "files": {name: [appeared, length, same, taken]}}.

    A listing like the one before leaves the offset as it is, unless taken files are still to be archived:
    the engine commits a batch when it begins the next one.
    """
    n, files = before["n"] + 1, {}
    for name, length in sorted(sizes.items()):
        appeared, size, same, taken = before["files"].get(name, (n, -1, 0, False))
        same = same + 1 if length == size else 0
        files[name] = [appeared, length, min(same, checks), taken or (same >= checks and length > 0)]
    waits = archived and any(f[3] for f in files.values())
    return before if files == before["files"] and not waits else {"n": n, "files": files}


def newly_taken(start: dict, end: dict) -> list[tuple[str, int]]:
    """Names and sizes of the files that end has taken and start had not."""
    old = {(name, f[0]) for name, f in start["files"].items() if f[3]}
    return [(name, f[1]) for name, f in sorted(end["files"].items()) if f[3] and (name, f[0]) not in old]


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.archive = options["path"], options.get("archive")
        self.checks, self.names = int(options.get("checks", CHECKS)), re.compile(options.get("names", NAMES), re.IGNORECASE)
        self.current: dict | None = None

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {"n": 0, "files": {}}

    def latestOffset(self) -> dict:
        fs, root = self._open()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        sizes = {x.base_name: x.size for x in found if x.is_file and self.names.fullmatch(x.base_name)}
        self.current = listed(self.current or self.initialOffset(), sizes, self.checks, bool(self.archive))
        return self.current

    def partitions(self, start: dict, end: dict) -> list[Taken]:
        # after a restart the engine plans the last batch of the checkpoint first, so its end is what this run goes on from
        self.current = self.current or end
        groups: list[list[tuple[str, int]]] = []
        room = 0
        for name, length in newly_taken(start, end):
            if not groups or length > room:
                groups.append([])
                room = TASK_BYTES
            groups[-1].append((name, length))
            room -= length
        return [Taken(tuple(g)) for g in groups]

    def read(self, partition: Taken) -> Iterator[pa.RecordBatch]:
        """One batch a file; a file that has gone meanwhile has no content."""
        fs, root = self._open()
        for name, length in partition.files:
            place = self._place(fs, root, name)
            info = fs.get_file_info(place)
            content = None
            if info.is_file:
                with fs.open_input_stream(place) as stream:
                    content = stream.read()
            modified = info.mtime if info.is_file else datetime.fromtimestamp(0, UTC)
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(root, name)]), pa.array([modified], pa.timestamp("us", "UTC")), pa.array([length], pa.int64()), pa.array([content], pa.binary())], ["path", "modified", "length", "content"])

    def _place(self, fs: pafs.FileSystem, root: str, name: str) -> str:
        """Where a taken file is: in the folder, or in the archive if its batch is run again after its commit."""
        place = posixpath.join(root, name)
        if self.archive and not fs.get_file_info(place).is_file:
            return posixpath.join(pafs.FileSystem.from_uri(self.archive)[1], name)
        return place

    def commit(self, end: dict) -> None:
        if not self.archive:
            return
        fs, root = self._open()
        target = pafs.FileSystem.from_uri(self.archive)[1]
        fs.create_dir(target, recursive=True)
        for name, (appeared, _, _, taken) in end["files"].items():
            place, kept = posixpath.join(root, name), posixpath.join(target, name)
            if taken and fs.get_file_info(place).is_file:
                if fs.get_file_info(kept).is_file:
                    stem, dot, suffix = name.rpartition(".")
                    kept = posixpath.join(target, f"{stem}-{appeared}{dot}{suffix}")
                fs.move(place, kept)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options)


def arrivals(spark: SparkSession, path: str, archive: str | None = None, checks: int = CHECKS) -> DataFrame:
    """The PDF files of a folder (a URI) as a stream of path, modified, length and content, each once.

    A trigger is a listing, and a file is taken at the listing that has found its size unchanged checks
    times; empty files wait. The offset grows with the files that lie in the folder, so a busy folder
    should have an archive folder (of the same file system).
    """
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format("arrivals").option("checks", checks)
    return (reader.option("archive", archive) if archive else reader).load(path)


def appearances(listings: DataFrame, checks: int = CHECKS) -> DataFrame:
    """arrivals() over a table of listings (n, path, length): path, appeared, taken_at and length of each file that settled.

    Listings of a path that follow each other without a gap are one appearance; it is taken once.
    """
    by_path = Window.partitionBy("path").orderBy("n")
    rows = listings.withColumn("_island", F.col("n") - F.row_number().over(by_path))
    w = Window.partitionBy("path", "_island").orderBy("n")
    rows = rows.withColumns({"appeared": F.min("n").over(w), "_change": F.coalesce((F.col("length") != F.lag("length").over(w)).cast("int"), F.lit(1))})
    rows = rows.withColumn("_run", F.sum("_change").over(w))
    same = F.row_number().over(Window.partitionBy("path", "_island", "_run").orderBy("n")) - 1
    settled = rows.withColumn("_same", same).where((F.col("_same") >= checks) & (F.col("length") > 0))
    return settled.groupBy("path", "appeared").agg(F.min("n").alias("taken_at"), F.min_by("length", "n").alias("length"))
