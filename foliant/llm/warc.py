"""WARC archives as a Spark Python data source, and a writer that stores equal payloads once.

Reading plans one partition for each group of archive files, takes over predicates on the record
type and on named headers, parses a record's headers first and inflates its payload only if the
record passes and payloads are wanted. Records are gzip members of their own whose extra field
``sl`` holds the member's length (as the WARC standard's annex on compression has it), so that an
unwanted record is passed by with one seek. A member of 4 GB or more has no such field, as its
lengths would not fit; it is inflated to its end.

A write job adds one manifest, which names its files with their sizes; it appears by a rename once
all tasks are committed, and what no manifest names is not read. Reading takes all manifests, so
appended jobs add up, and asks no file for its size. A job that overwrites names the manifests that
it replaces: it takes effect as a whole when its own appears, and deletes the old files afterwards.
A folder without manifests is listed; a file of such a folder is read by one task, as its records'
places are not known before. Its members may hold several records, and its names may be in any
letter case. A file that ends within a record is an error that names the record's place.

Folders are opened by pyarrow: local files, hdfs and s3 (also written s3a or s3n).
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, pages, small, written

#: Columns that are headers, and their names in the archive (fixed values of the standard, X- ours).
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "profile": "WARC-Profile",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "refers_to_page": "X-Refers-To-Page",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, file string, offset long, payload binary"
#: What a revisit record says of itself (fixed value of the standard).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file is closed at this size, and files are grouped to partitions of it (option fileBytes).
FILE_BYTES = 64 << 20
MOST_LENGTH = 0xFFFFFFFF
BATCH_BYTES = 4 << 20
HEAD_CHUNK = 2048


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop's names of S3 are pyarrow's s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member with its own length in the extra field ``sl``."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = ("WARC/1.1\r\n" + "".join(f"{x}\r\n" for x in lines) + f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = head + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = deflate.compress(head) + deflate.flush(zlib.Z_SYNC_FLUSH) + deflate.compress(body[len(head) :]) + deflate.flush()
    trailer = struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)
    size = 24 + len(data) + 8
    if max(size, len(body)) > MOST_LENGTH:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + data + trailer
    extra = b"sl" + struct.pack("<HII", 8, size, len(body))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + trailer


def _clean(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    return out


def _by_name(headers: dict[str, str]) -> dict[str, str]:
    """Headers under lower-case names, as the standard's names ignore case."""
    return {k.lower(): v for k, v in headers.items()}


class _Member:
    """The records from a place in an open archive on: those of one gzip member, or all that follow in a plain file."""

    def __init__(self, stream: pa.NativeFile, offset: int, size: int):
        self.stream, self.offset, self.size, self.end, self.buffer = stream, offset, size, None, b""
        stream.seek(offset)
        first = stream.read(12)
        self.inflate = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        if self.inflate and len(first) == 12 and first[3] & 4:
            extra = stream.read(struct.unpack("<H", first[10:12])[0])
            while len(extra) >= 4:
                name, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if name == b"sl" and n >= 4:
                    self.end = offset + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        stream.seek(offset)

    def _cut_off(self) -> ValueError:
        return ValueError(f"the record at {self.offset} is cut off by the end of the file")

    def _grow(self, want: int) -> bool:
        """Reads on; False at the member's end. A file that ends before its member does is an error."""
        if self.inflate and self.inflate.eof:
            return False
        chunk = self.stream.read(want)
        if not chunk:
            if self.inflate:
                raise self._cut_off()
            return False
        self.buffer += self.inflate.decompress(chunk) if self.inflate else chunk
        return True

    def _head(self) -> bytes | None:
        """The next record's headers, or None behind the last record."""
        while not self.buffer.lstrip(b"\r\n"):
            if not self._grow(HEAD_CHUNK):
                return None
        self.buffer = self.buffer.lstrip(b"\r\n")
        if not self.inflate:
            self.offset = self.stream.tell() - len(self.buffer)
        while b"\r\n\r\n" not in self.buffer:
            if not self._grow(HEAD_CHUNK):
                raise ValueError(f"the record at {self.offset} has no end of headers")
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {self.offset}")
        return head

    def _take(self, n: int, keep: bool) -> bytes:
        parts, left = [], n
        if not keep and not self.inflate and left > len(self.buffer):
            self.stream.seek(self.stream.tell() + left - len(self.buffer))
            self.buffer, left = b"", 0
            if self.stream.tell() > self.size:
                raise self._cut_off()
        while left:
            if not self.buffer and not self._grow(max(HEAD_CHUNK, min(left, 1 << 20))):
                raise self._cut_off()
            part, self.buffer = self.buffer[:left], self.buffer[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def records(self, passes: Callable[[dict[str, str]], bool], want: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
        """Headers, place and payload (if wanted) of each record that passes; self.next is then where the next member starts."""
        while (head := self._head()) is not None:
            headers = _parse(head)
            passed, length = passes(headers), int(_by_name(headers).get("content-length", "0"))
            if self.end is not None and not (passed and want):  # a member with its length has one record
                if passed:
                    yield headers, self.offset, None
                break
            payload = self._take(length, passed and want)
            if passed:
                yield headers, self.offset, payload if want else None
        if self.end is not None:
            self.next = self.end
            if self.end > self.size:
                raise self._cut_off()
        else:
            self.next = self.stream.tell() - len(self.inflate.unused_data) if self.inflate else self.size


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, int], ...]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


MANIFEST = "_manifest-"


def _manifests(fs: pafs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests of a folder that count, by name: all but those that another one replaces."""
    found = {}
    for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if x.base_name.startswith(MANIFEST):
            with fs.open_input_stream(x.path) as s:
                found[x.base_name] = json.loads(s.read())
    replaced = {old for m in found.values() for old in m["replaces"]}
    return {n: m for n, m in found.items() if n not in replaced}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.want = options["path"], options.get("payload", "true").lower() != "false"
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.tests: list[tuple[str, frozenset[str] | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and presence tests on columns that are headers; returns the others."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((name, frozenset([f.value])))
            elif name and isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.tests.append((name, frozenset(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        manifests = _manifests(fs, root)
        if manifests:
            sized = [(posixpath.join(root, n), size) for m in manifests.values() for n, size in m["files"]]
        else:
            listed = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            sized = [(x.path, x.size) for x in listed if x.path.endswith((".warc", ".warc.gz")) and not posixpath.basename(x.path).startswith("_")]
        groups: list[list[tuple[str, int]]] = []
        room = 0
        for path, size in sorted(sized):
            if size > room or not groups:
                groups.append([])
                room = self.file_bytes
            groups[-1].append((path, size))
            room -= size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def _passes(self, headers: dict[str, str]) -> bool:
        named = _by_name(headers) if self.tests else {}
        return all((named.get(n.lower()) in ok) if ok is not None else n.lower() in named for n, ok in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.paths:
            with fs.open_input_file(path) as stream:
                at = 0
                while at < size:
                    member = _Member(stream, at, size)
                    for headers, place, payload in member.records(self._passes, self.want):
                        rows.append((headers, path, place, payload))
                        held += len(payload or b"") + 1000
                        if held >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, held = [], 0
                    at = member.next
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        named = [_by_name(h) for h, *_ in rows]
        columns = [pa.array([h.get(name.lower()) for h in named], pa.string()) for name in HEADERS.values()]
        columns.append(pa.array([list(h.items()) for h, *_ in rows], pa.map_(pa.string(), pa.string())))
        columns += [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*HEADERS, "headers", "file", "offset", "payload"])


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own name; only files of tasks that were committed enter the job's manifest."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        fs, root = _open(self.path)
        self.replaces = sorted(_manifests(fs, root)) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            columns = {n: batch.column(n) for n in batch.schema.names}
            payloads = columns.pop("payload").to_pylist()
            heads = {n: c.to_pylist() for n, c in columns.items() if n in HEADERS}
            for i, payload in enumerate(payloads):
                if out is not None and size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                headers = {"WARC-Date": self.now, "Content-Type": "text/html"}
                headers |= {HEADERS[n]: _clean(v[i]) for n, v in heads.items() if v[i] is not None}
                data = record_bytes(headers, payload or b"")
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        old = {n: m for n, m in _manifests(fs, root).items() if n in self.replaces}
        name = uuid.uuid4().hex
        draft = posixpath.join(root, f"_draft-{name}")
        with fs.open_output_stream(draft) as s:
            s.write(json.dumps({"files": sorted(f for m in messages if m for f in m.files), "replaces": self.replaces}).encode())
        fs.move(draft, posixpath.join(root, f"{MANIFEST}{name}.json"))
        for files in [m["files"] for m in old.values()]:
            for n, _ in files:
                fs.delete_file(posixpath.join(root, n))
        for n in old:
            fs.delete_file(posixpath.join(root, n))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for n, _ in m.files if m else ():
                fs.delete_file(posixpath.join(root, n))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path. Without payload, payloads are not inflated and the column is null."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes the header columns of HEADERS that df has, and its payload, as one record a row.

    mode is append or overwrite. A record without a date gets the job's.
    """
    register(df.sparkSession)
    df.write.format("warc").mode(mode).save(path)


def with_revisits(table: DataFrame, key: str, payload: str, least_bytes: int = 100) -> DataFrame:
    """table with payload (binary; null: empty), payload_digest, payload_length, record_type and refers_to_page.

    Of rows with equal payloads of least_bytes or more, the one with the smallest key is a response
    and the others revisit it; a repeated row with the smallest key is a response again, as is a row
    without a key. Digests meet after pre-aggregation, in rows of a digest and a key only; the
    payloads are joined with the revisits alone, which are broadcast if their number allows.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")) if dict(table.dtypes)[payload] == "string" else F.coalesce(F.col(payload), F.lit(b""))
    base = table.select(F.col(key).alias("_key"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).cast("long").alias("_size")).where(F.col("_size") >= least_bytes)
    firsts = base.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = written(base.join(firsts, "_digest").where("_key > _first").select(F.col("_key").alias(key), F.col("_digest").alias("payload_digest"), F.col("_first").alias("refers_to_page")).distinct(), "revisits")
    others = [c for c in table.columns if c != payload]
    out = table.select(*others, body.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).join(small(revisits), [key, "payload_digest"], "left")
    return out.select(
        *others,
        "payload",
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(F.col("refers_to_page").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to_page",
    )


def archive(table: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", mode: str = "append") -> None:
    """Writes table (its columns key, url and html) as WARC; a revisit's record has no payload of its own.

    Records are named by their key, so that a revisit can refer to a response; rows that repeat a key
    repeat the name, and so do archives of two tables with the same keys. Payloads are compared within the
    table, not with what the folder holds already.
    """
    rows = with_revisits(table.select(F.col(key).alias("page_id"), F.col(url).alias("target_uri"), F.col(html).alias("html")), "page_id", "html")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    write_warc(
        rows.select(
            F.col("page_id").cast("string").alias("page_id"),
            "record_type",
            F.coalesce(name(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"),
            "target_uri",
            F.when(F.col("record_type") == "revisit", SAME_PAYLOAD).alias("profile"),
            F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
            name(F.col("refers_to_page")).alias("refers_to"),
            F.col("refers_to_page").cast("string").alias("refers_to_page"),
            F.col("payload_length").cast("string").alias("payload_length"),
            F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        ),
        path,
        mode,
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back. A response's size and digest are those of the payload
    read; a revisit's are those its headers state.

    A null html is an empty payload, and one of any length is a record; a page without an id is a
    response. Equal payloads go by the smallest page_id, rows that repeat it are responses as well. Other
    columns are not archived. An empty table gives an archive without records.
    """
    path = new_path(spark, "warc")
    archive(pages(spark, sf_dir), path)
    both = read_warc(spark, path)
    page = F.col("page_id").cast("long").alias("page_id")
    responses = both.where(F.col("record_type") == "response").select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = read_warc(spark, path, payload=False)
    revisits = heads.where(F.col("record_type") == "revisit").select(page, F.col("payload_length").cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND d.payload_digest = f.payload_digest
"""
