"""What the corpus operators share: the shared folder, written tables, joins by checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (ids and a few numbers) up to which it is broadcast; about 20 MB.
BROADCAST_ROWS = 200_000
#: Rows and bytes of a slice of texts that a worker turns into Python objects at once.
TEXT_BATCH_ROWS = 1_000
TEXT_BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, else, in local mode alone, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that each open scope() is to delete, the innermost last; each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder within it is deleted at its end; so results are to be written or collected inside.

        with scope(spark):
            near_duplicates(docs).write.parquet(path)
    """
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            discard(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def written(df: DataFrame, name: str, with_path: bool = False, **options: object) -> DataFrame | tuple[DataFrame, str]:
    """df, written as Parquet (with options) in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most TEXT_BATCH_ROWS rows and, as far as whole rows allow, near TEXT_BATCH_BYTES."""
    for batch in batches:
        rows = max(1, min(TEXT_BATCH_ROWS, batch.num_rows * TEXT_BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df through function in small slices. Spark limits the bytes of its batches; the session's settings stay as they are."""
    return df.mapInArrow(lambda batches: function(slices(batches)), schema)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """table, marked for broadcast if it has at most BROADCAST_ROWS rows (rows: their number, else they are counted)."""
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def salted_join(big: DataFrame, other: DataFrame, on: str, spread: str, salts: int = 16) -> DataFrame:
    """big left join other (one row a key) where a key may be hot in big: rows of a key meet in salts places, dealt by spread."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], "left").drop("_salt")
