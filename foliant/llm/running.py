"""Places of rows in an order, and sums of what comes before them, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, salted_join, small, written


def _sums(amount: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            amounts = batch.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = total + np.cumsum(amounts)
            columns = [*batch.columns, pa.array(np.full(len(amounts), part, np.int32)), pa.array(upto - amounts)]
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_run"])

    return run


def laid_out(rows: DataFrame, key: str, order: list, amount: str) -> DataFrame:
    """rows with `before`: the sum of amount over the rows of the same key that come earlier in order.

    rows is a narrow written table (Spark samples it for its ranges before it sorts it). key and
    amount have no nulls. Ranges of the sort cut through hot keys, and even through equal rows: each
    range sums by itself, and a table of a row for each key and range gives what the ranges before
    it have. Equal rows come in any order; an empty table gives an empty one.
    """
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(key, *order, "_spread").sortWithinPartitions(key, *order, "_spread").drop("_spread")
    schema = StructType([*ordered.schema.fields, StructField("_part", IntegerType()), StructField("_run", LongType())])
    placed = written(ordered.mapInArrow(_sums(amount), schema), "placed")
    parts = placed.groupBy(key, "_part").agg(F.min("_run").alias("_first"), F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_part", (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = placed.join(small(written(parts, "parts")), [key, "_part"])
    return out.withColumn("before", F.col("_run") + F.col("_shift")).drop("_part", "_run", "_shift")


def keyed(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """rows with the columns of table (written, one row a key): a broadcast of checked size, else a join that parts hot keys."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    return salted_join(rows, table, key, spread)
