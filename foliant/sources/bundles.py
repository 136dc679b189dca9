"""One ZIP container for each case, written as a stream, with the members that failed set apart.

A task writes the containers of its cases one after the other into a folder of its own, member by
member, so that a container is never held in memory, and a list of failures beside them. The job's
commit moves the folders of the tasks that were committed to their places; what another attempt of a
task has written is deleted with the job's drafts. A member that cannot be written (it has an error
already, no content, a name that leaves the container, or the name of another) is a row among the
failures and does not fail its case.

A file takes a block of the disk at least, so many small containers may be packed: whole ZIPs up to
PACKED bytes lie side by side as rows of compressed Parquet files, larger ones are files of their own.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "container string, member string, content binary, error string"
FAILURES = "_failures"
DRAFTS = "_drafts-"
#: Containers in one reading task, in bytes.
TASK_BYTES = 64 << 20
SMALL = 1 << 16
#: The largest container in a pack, and what is gathered for one group of a pack's rows, in bytes.
PACKED = 1 << 20
GATHERED = 8 << 20
PACK = ".zips"
#: How many times as long a pack's containers are about (many small members with names alike).
SHRUNK = 16
PACK_SCHEMA = pa.schema([("container", pa.string()), ("zip", pa.binary())])
#: Content below this is stored as it is, as deflating makes it longer.
STORED = 64
#: A time for all members, so that a container's bytes follow from its rows (fixed value: the first that ZIP has).
EPOCH = (1980, 1, 1, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    draft: str | None
    folder: str


def file_name(container: str) -> str:
    """A container's name as a file name: separators and control characters become _."""
    return re.sub(r"[\x00-\x1f/\\:]", "_", container).strip() or "_"


def refusal(member: str | None, content: bytes | None, error: str | None, before: set[str]) -> str | None:
    """Why a member cannot be in its container."""
    if error:
        return error
    if not member or member.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", member) or re.search(r"[\x00-\x1f]", member):
        return "UNSAFE_NAME"
    if member in before:
        return "REPEATED_NAME"
    return "NO_CONTENT" if content is None else None


class Spool:
    """A container's stream: kept up to `most` bytes, beyond that a file."""

    def __init__(self, fs: pafs.FileSystem, path: str, most: int):
        self.fs, self.path, self.most = fs, path, most
        self.kept, self.file = io.BytesIO(), None

    def write(self, data: bytes) -> int:
        if self.file is None and self.kept.tell() + len(data) > self.most:
            self.file = self.fs.open_output_stream(self.path, compression=None)
            self.file.write(self.kept.getbuffer())
        return (self.file or self.kept).write(data)

    def flush(self) -> None:
        pass

    def close(self) -> bytes | None:
        """The container, unless it is a file."""
        if self.file is None:
            return self.kept.getvalue()
        self.file.close()
        return None


class Packs:
    """A task's packs: rows of whole containers, gathered into row groups, in files that hold about TASK_BYTES before compression."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.fs, self.folder = fs, folder
        self.rows: list[tuple[str, bytes]] = []
        self.bytes, self.n, self.stream, self.writer = 0, 0, None, None

    def add(self, name: str, data: bytes) -> None:
        self.rows.append((name, data))
        self.bytes += len(data)
        if self.bytes >= GATHERED:
            self._put()

    def _put(self) -> None:
        if self.writer is None:
            self.stream = self.fs.open_output_stream(posixpath.join(self.folder, f"{self.n:05d}{PACK}"), compression=None)
            self.writer = pq.ParquetWriter(self.stream, PACK_SCHEMA, compression="zstd", use_dictionary=False, write_statistics=False)
            self.n += 1
        self.writer.write_table(pa.table([[r[k] for r in self.rows] for k in range(2)], schema=PACK_SCHEMA))
        self.rows, self.bytes = [], 0
        if self.stream.tell() >= TASK_BYTES // SHRUNK:
            self._end()

    def _end(self) -> None:
        self.writer.close()
        self.stream.close()
        self.writer = None

    def close(self) -> None:
        if self.rows:
            self._put()
        if self.writer is not None:
            self._end()


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.packed = options.get("packed", "false").lower() == "true"

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a container follow each other."""
        fs, root = self._open()
        part = TaskContext.get().partitionId()
        draft = posixpath.join(root, f"{DRAFTS}{self.job}", f"{part}-{uuid.uuid4().hex}")
        name, container, stream, members, done = None, None, None, set(), set()
        packs, failures = Packs(fs, draft), None

        def close() -> None:
            if container is not None:
                container.close()
                data = stream.close()
                if data is not None:
                    packs.add(name, data)

        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("container", "member", "content", "error"))):
                if container is None or row[0] != name:
                    close()
                    if not done:
                        fs.create_dir(draft, recursive=True)
                    name, members = row[0], set()
                    if name in done:
                        raise ValueError(f"the rows of container {name!r} do not follow each other")
                    done.add(name)
                    stream = Spool(fs, posixpath.join(draft, f"{file_name(name)}.zip"), PACKED if self.packed else -1)
                    container = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                why = refusal(*row[1:], members)
                if why:
                    if failures is None:
                        failures = fs.open_output_stream(posixpath.join(draft, f"{FAILURES}.json.gz"), compression="gzip")
                    failures.write(json.dumps({"container": name, "member": row[1] or "", "error": why}, ensure_ascii=False).encode() + b"\n")
                    continue
                members.add(row[1])
                container.writestr(zipfile.ZipInfo(row[1], EPOCH), row[2], zipfile.ZIP_DEFLATED if len(row[2]) >= STORED else zipfile.ZIP_STORED)
        close()
        packs.close()
        if failures is not None:
            failures.close()
        return Written(draft if container is not None else None, f"part-{part:05d}-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        old = [x for x in fs.get_file_info(pafs.FileSelector(root)) if not x.base_name.startswith(DRAFTS)] if self.overwrite else []
        for m in messages:
            if m and m.draft:
                fs.move(m.draft, posixpath.join(root, m.folder))
        for x in old:
            if x.is_file:
                fs.delete_file(x.path)
            else:
                fs.delete_dir(x.path)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        drafts = posixpath.join(root, f"{DRAFTS}{self.job}")
        if fs.get_file_info(drafts).type == pafs.FileType.Directory:
            fs.delete_dir(drafts)


@dataclass
class Containers(InputPartition):
    paths: tuple[str, ...]


class BundleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Containers]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        groups: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            wanted = x.base_name.endswith((".zip", PACK)) or (x.base_name.startswith(FAILURES) and x.base_name.endswith((".json", ".json.gz")))
            if not x.is_file or not wanted or f"/{DRAFTS}" in x.path:
                continue
            size = x.size * SHRUNK if x.base_name.endswith((PACK, ".gz")) else x.size
            if not groups or size > room:
                groups.append([])
                room = TASK_BYTES
            groups[-1].append(x.path)
            room -= size
        return [Containers(tuple(g)) for g in groups] or [Containers(())]

    def read(self, partition: Containers) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            if path.endswith((".json", ".json.gz")):
                with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
                    for line in io.BufferedReader(stream):
                        x = json.loads(line)
                        yield x["container"], x["member"], None, x["error"]
                continue
            with fs.open_input_file(path) as stream:
                if path.endswith(PACK):
                    for batch in pq.ParquetFile(stream).iter_batches(1024):
                        for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                            yield from self._members(file_name(name), io.BytesIO(data))
                    continue
                # small ones as a whole: the reader looks for an end record before a small file's start, which the stream refuses
                yield from self._members(posixpath.basename(path).removesuffix(".zip"), stream if stream.size() > SMALL else io.BytesIO(stream.read()))

    @staticmethod
    def _members(name: str, stream: io.IOBase) -> Iterator[tuple]:
        with zipfile.ZipFile(stream) as container:
            for member in container.namelist():
                yield name, member, container.read(member), None


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options, overwrite)


def write_bundles(members: DataFrame, path: str, mode: str = "append", packed: bool = False) -> None:
    """Writes rows (container, member, content, error; error may be missing) as one ZIP a container under path (a URI).

    A container's members come in the order of their names and pass through one task, which holds one
    member at a time; containers are dealt by their names. mode is append or overwrite; packed puts containers up to PACKED
    bytes side by side into packs instead of files of their own.
    """
    members.sparkSession.dataSource.register(BundleSource)
    error = F.col("error") if "error" in members.columns else F.lit(None).cast("string")
    rows = members.where("container is not null").select("container", "member", F.col("content").cast("binary").alias("content"), error.alias("error"))
    rows.repartition("container").sortWithinPartitions("container", "member", F.col("error").asc_nulls_first(), F.sha2("content", 256)).write.format("bundles").option("packed", str(packed).lower()).mode(mode).save(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """container, member and content of all members under path, and the failures as rows with an error and no content."""
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundles").load(path)
