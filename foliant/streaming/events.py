"""Event operators that read alike on a stream and on a table.

Aggregations by time take a watermark on streams and ignore it on tables. The stateful operator keeps
one counter a key, with its expiry, in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import stored


def latest(messages: DataFrame) -> DataFrame:
    """Per task, the last status and progress (0 to 100): task_id, status, progress, seq."""
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))
    return messages.groupBy("task_id").agg(F.max_by(F.struct("status", clamped.alias("progress")), "seq").alias("m"), F.count("*").alias("messages")).select("task_id", "m.*", "messages")


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Events and sum of value by window and keys."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def sliding(events: DataFrame, width: str, step: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no pause of gap or more."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), "n")


def rate_limits(errors: DataFrame, base: int = 8, most: int = 5) -> DataFrame:
    """Per model and minute: refusals, and the limit that follows (halved from five refusals on, at least 1).

    Minutes are those of the clock, while a counter that starts with its first refusal would also see a burst across two of them.
    """
    counts = errors.groupBy("model", F.window("ts", "60 seconds")).agg(F.count("*").alias("refusals"))
    return counts.select("model", F.col("window.start").alias("start"), "refusals", F.when(F.col("refusals") >= most, F.greatest(F.lit(1), F.lit(base // 2))).otherwise(base).alias("permits"))


def clamped(value: Column, shift: Column, lower: Column, upper: Column) -> Column:
    """value after a map of a count: shifted, then kept between two bounds."""
    return F.least(upper, F.greatest(lower, value + shift))


def _maps_before(cap: int):
    """Rows in order of key, each with its partition, its place there, and the map that the key's rows before it in the partition make.

    Changes between 0 and cap are maps of one form, a shift and two bounds, and so is one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, begun, now = TaskContext.get().partitionId(), 0, False, None
        shift, lower, upper = 0, 0, cap
        for batch in batches:
            shifts, lowers, uppers = [], [], []
            for key, change in zip(batch.column("key").to_pylist(), batch.column("_change").to_pylist()):
                if not begun or key != now:
                    begun, now = True, key
                    shift, lower, upper = 0, 0, cap
                shifts.append(shift)
                lowers.append(lower)
                uppers.append(upper)
                shift, lower, upper = shift + change, min(cap, max(0, lower + change)), min(cap, max(0, upper + change))
            n = batch.num_rows
            added = [pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), *(pa.array(x, pa.int64()) for x in (shifts, lowers, uppers))]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_part", "_place", "_shift", "_lower", "_upper"])

    return run


@F.arrow_udf(ArrayType(LongType()))
def starts(maps: pa.Array) -> pa.Array:
    """The count before each of a key's stretches, from the maps (shift, lower, upper) of whole stretches in order; the first begins at 0."""
    out = []
    for stretches in maps.to_pylist():
        counts = [0]
        for m in stretches[:-1]:
            counts.append(min(m["upper"], max(m["lower"], counts[-1] + m["shift"])))
        out.append(counts)
    return pa.array(out, pa.list_(pa.int64()))


def running(events: DataFrame, cap: int, partitions: int | None = None) -> DataFrame:
    """events (key, seq, change of +1 or -1) with used, the permits in use after each, and before, for tables.

    The count is never below 0, and never above cap, as an acquisition beyond it is refused and changes nothing. Events of a key
    with one seq go by their change. Ranges of the sort cut through hot keys, whatever their numbers look like; each range folds
    its rows once, and what a range hands on to the next is one row, so what is broadcast has at most a row a partition.
    """
    others = [c for c in events.columns if c not in ("key", "seq")]
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), *others, F.col("change").cast("long").alias("_change"))
    order = ["key", "seq", "_change", *[c for c in others if c != "change"]]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), *(StructField(c, LongType()) for c in ("_place", "_shift", "_lower", "_upper"))])
    placed = stored(ranged.sortWithinPartitions(*order).mapInArrow(_maps_before(cap), schema), "placed")

    bounded = lambda c: clamped(F.col(c), F.col("_change"), F.lit(0), F.lit(cap))
    whole = F.struct((F.col("_shift") + F.col("_change")).alias("shift"), bounded("_lower").alias("lower"), bounded("_upper").alias("upper"))
    stretches = placed.groupBy("key", "_part").agg(F.max_by(whole, "_place").alias("map"))
    cut = stretches.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_part", "map"))).alias("s")).where(F.size("s") > 1)
    begun = cut.withColumn("_starts", starts(F.transform("s", lambda x: x["map"]))).select(F.col("key").alias("_key"), F.posexplode("s").alias("_k", "_s"), "_starts")
    begun = begun.where("_k > 0").select("_key", F.col("_s._part").alias("_at"), F.get("_starts", F.col("_k")).alias("_start"))
    met = placed.join(F.broadcast(begun), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    out = met.withColumn("before", clamped(F.coalesce("_start", F.lit(0)), F.col("_shift"), F.col("_lower"), F.col("_upper")))
    return out.select("key", "seq", *others, clamped(F.col("before"), F.col("_change"), F.lit(0), F.lit(cap)).alias("used"), "before")


def admissions(events: DataFrame, cap: int) -> DataFrame:
    """events with used, the permits in use after each, and admitted: whether an acquisition came while fewer than cap were in use."""
    return running(events, cap).withColumn("admitted", (F.col("change") > 0) & (F.col("before") < cap)).drop("before")


def fresh_files(files: DataFrame, keys: tuple[str, ...] = ("tenant_id", "md5"), late: str = "1 day") -> DataFrame:
    """The first arrival of each content of a tenant (with a ts), on a stream or a table."""
    if files.isStreaming:
        return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return files.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in files.columns if c not in keys]), F.struct("ts", "path")).alias("f")).select(*keys, "f.*")


PERMITS = "key string, seq long, used long, admitted boolean"


def permits(events: DataFrame, cap: int, expiry_ms: int, late: str = "10 minutes") -> DataFrame:
    """Acquisitions and releases of a stream (key, seq, ts, change) answered from a counter a key.

    An acquisition beyond cap is refused and changes nothing; a release never goes below 0; a counter ends expiry_ms after it last
    rose from 0. Events of a key in one batch are taken in order of seq; events later than the watermark are left out.
    Only counters above 0 are kept, until the watermark passes their end.
    """

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, ends = state.get if state.exists else (0, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            now = int(r.ts.timestamp() * 1000)
            if used and now >= ends:
                used = 0
            admitted = r.change > 0 and used < cap
            if admitted and not used:
                ends = now + expiry_ms
            used = used + 1 if admitted else max(0, used - 1) if r.change < 0 else used
            rows.append((key[0], r.seq, used, admitted))
        if used:
            state.update((used, ends))
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "seq", "used", "admitted"])

    marked = events.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(answer, PERMITS, "used long, ends long", "append", "EventTimeTimeout")
