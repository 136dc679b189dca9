"""Permits of models with a limit that changes, requests that wait for one, and refused calls that are tried again.

A model has so many permits. A request that finds none free, or others waiting, waits its turn until
its deadline. Permits end together a minute after the first of them was taken. Five refusals by the
model within a minute halve its limit until that minute ends; a refused call is told how long to wait
before it tries again, twice as long each time.

The rules are one small machine, `Desk`, that takes a model's events in order of time. A stream keeps
events in state until the watermark has passed them, so order of arrival does not matter, and timers
give answers that no event brings (a deadline, the end of the permits). A table is cut where a model
rested long enough to have forgotten everything, and each stretch is folded by itself, as its sorted
rows come: an event costs the desk the logarithm of how many wait, and a task holds no more than who waits.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Lifetime of permits and window of refusals in ms, refusals that halve the limit, tries and first pause of a refused call, longest wait in ms.
PERMIT_MS = 60_000
REFUSAL_MS = 60_000
REFUSALS = 5
RETRIES = 3
FIRST_PAUSE_S = 2.0
WAIT_MS = 60_000
#: Base limits by model; other models have OTHERS (fixed values).
LIMITS = {"text": 10, "ocr": 5, "flash": 20}
OTHERS = 5

ANSWERS = "model string, request string, outcome string, at_ms long, waited_s double, used int, permits int"
ANSWERS_AT_ONCE = 20_000
EVENT = "seq long, request string, action string, at_ms long, wait_ms long"


@dataclass
class Desk:
    """One model's permits, waiting requests and refusals; times in ms, answers as (request, outcome, at, seconds).

    Who waits is kept in order of arrival, and by deadline in a heap (that of a request which has been granted is passed over
    later); events come in order of time, so tries end in the order in which they were noted.
    """

    base: int
    used: int = 0
    ends: int = 0
    refusals: int = 0
    refusals_end: int = 0
    waiting: list[tuple[str, int, int]] = field(default_factory=list)
    tries: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._queue = OrderedDict(enumerate(self.waiting))
        self._n = len(self._queue)
        self._deadlines = [(w[2], k) for k, w in self._queue.items()]
        heapq.heapify(self._deadlines)
        self._ends_of_tries = deque(sorted((until, request) for request, (_, until) in self.tries.items()))

    def waits(self) -> list[tuple[str, int, int]]:
        return list(self._queue.values())

    def permits(self) -> int:
        return max(1, self.base // 2) if self.refusals >= REFUSALS else self.base

    def next_change(self) -> int | None:
        """When something happens next without an event."""
        self._forget()
        times = [self._ends_of_tries[0][0]] if self._ends_of_tries else []
        at = self._next_grant_or_refusal()
        return min([*times, at] if at is not None else times, default=None)

    def _next_grant_or_refusal(self) -> int | None:
        """next_change without the ends of tries, which let nobody in."""
        deadlines, queue = self._deadlines, self._queue
        while deadlines and deadlines[0][1] not in queue:
            heapq.heappop(deadlines)
        at = deadlines[0][0] if deadlines else None
        if self.used and (at is None or self.ends < at):
            at = self.ends
        if self.refusals and (at is None or self.refusals_end < at):
            at = self.refusals_end
        return at

    def _forget(self, now: int | None = None) -> None:
        """Drops tries that ended by now, and ends that are no longer those of a try."""
        ends, tries = self._ends_of_tries, self.tries
        while ends:
            until, request = ends[0]
            stands = tries.get(request, (0, None))[1] == until
            if stands and (now is None or until > now):
                break
            ends.popleft()
            if stands:
                del tries[request]

    def _wait(self, request: str, now: int, deadline: int) -> None:
        self._queue[self._n] = request, now, deadline
        heapq.heappush(self._deadlines, (deadline, self._n))
        self._n += 1
        if len(self._deadlines) > 2 * len(self._queue) + 1000:
            self._deadlines = [(w[2], k) for k, w in self._queue.items()]
            heapq.heapify(self._deadlines)

    def _grant(self, now: int) -> Iterator[tuple]:
        while self._queue and self.used < self.permits():
            _, (request, since, _) = self._queue.popitem(last=False)
            yield self._take(request, since, now)

    def _take(self, request: str, since: int, now: int) -> tuple:
        self.used += 1
        if self.used == 1:
            self.ends = now + PERMIT_MS
        return request, "granted", now, (now - since) / 1000, self.used, self.permits()

    def pass_time(self, now: int) -> Iterator[tuple]:
        """What happens by itself up to now: deadlines first, then ends of permits and refusals, then grants."""
        while (at := self._next_grant_or_refusal()) is not None and at <= now:
            while self._deadlines and self._deadlines[0][0] <= at:
                waited = self._queue.pop(heapq.heappop(self._deadlines)[1], None)
                if waited:
                    yield waited[0], "refused", at, (at - waited[1]) / 1000, self.used, self.permits()
            if self.used and self.ends <= at:
                self.used = 0
            if self.refusals and self.refusals_end <= at:
                self.refusals = 0
            yield from self._grant(at)
        self._forget(now)

    def event(self, request: str, action: str, now: int, wait_ms: int | None) -> Iterator[tuple]:
        yield from self.pass_time(now)
        if action == "acquire":
            if self.used < self.permits():
                yield self._take(request, now, now)
            else:
                self._wait(request, now, now + (WAIT_MS if wait_ms is None else wait_ms))
        elif action == "release":
            self.used = max(0, self.used - 1)
            self.tries.pop(request, None)
            yield from self._grant(now)
        elif action == "refusal":
            if not self.refusals:
                self.refusals_end = now + REFUSAL_MS
            self.refusals += 1
            tried = self.tries.pop(request, (0, 0))[0]
            if tried < RETRIES:
                self.tries[request] = (tried + 1, now + PERMIT_MS)
                self._ends_of_tries.append((now + PERMIT_MS, request))
            yield request, "retry" if tried < RETRIES else "failed", now, FIRST_PAUSE_S * 2**tried if tried < RETRIES else 0.0, self.used, self.permits()


def base_limit(model: str) -> int:
    return LIMITS.get(model, OTHERS)


def _checked(events: DataFrame) -> DataFrame:
    """events (model, seq, request, action, ts, wait_s) in the columns of EVENT; rows without model, request or ts say nothing."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = events.where("model is not null and request is not null and ts is not null")
    return rows.withColumns({"seq": F.col("seq").cast("long"), "request": F.col("request").cast("string"), "at_ms": ms("ts"), "wait_ms": (F.col("wait_s") * 1000).cast("long")})


def answers(events: DataFrame) -> DataFrame:
    """The answers to a table of events (ANSWERS). Events of one time go by seq.

    A minute of the clock without events of a model between two with some may be a rest; the times of the
    first and last event of each minute tell where a model rested as long as anything is remembered, and
    the stretches in between are folded side by side. A model that never rests is one stretch, as each
    answer may depend on all events before.
    """
    rows = _checked(events)
    rest = max(PERMIT_MS, REFUSAL_MS)
    longest = F.coalesce(F.max(F.when(F.col("action") == "acquire", F.coalesce("wait_ms", F.lit(WAIT_MS)))), F.lit(0))
    rows = rows.withColumn("minute", F.expr(f"at_ms div {rest}"))
    minutes = rows.groupBy("model", "minute").agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), longest.alias("longest"))
    before = Window.partitionBy("model").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    # a waiting request keeps the desk busy until its deadline, and what it is granted then for as long as permits last
    busy_until = F.max(F.col("last") + F.col("longest")).over(before) + rest
    minutes = minutes.withColumn("starts", (F.coalesce(F.col("first") > busy_until, F.lit(True))).cast("int"))
    upto = Window.partitionBy("model").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    stretches = minutes.select(F.col("model").alias("_model"), F.col("minute").alias("_minute"), F.sum("starts").over(upto).alias("stretch"))
    rows = rows.join(stretches, (F.col("model") == F.col("_model")) & (F.col("minute") == F.col("_minute")))

    names = [c.split()[0] for c in ANSWERS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, types)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, desk, out = None, None, []

        def end() -> None:
            while desk is not None and (at := desk.next_change()) is not None:
                out.extend((now[0], *o) for o in desk.pass_time(at))

        for batch in batches:
            for model, stretch, request, action, at, wait in zip(*(c.to_pylist() for c in batch.columns)):
                if (model, stretch) != now:
                    end()
                    now, desk = (model, stretch), Desk(base_limit(model))
                out.extend((model, *o) for o in desk.event(request, action, at, wait))
                if len(out) >= ANSWERS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)
                    out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)

    dealt = rows.select("model", "stretch", "request", "action", "at_ms", "wait_ms", "seq").repartition("model", "stretch")
    return dealt.sortWithinPartitions("model", "stretch", "at_ms", F.asc_nulls_last("seq")).drop("seq").mapInArrow(fold, ANSWERS)


class LimiterProcessor(StatefulProcessor):
    """A model's desk in state: its numbers, its waiting requests, tries of refused calls, and events that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "used int, ends long, refusals int, refusals_end long")
        self.waiting = handle.getListState("waiting", "request string, since long, deadline long")
        self.tries = handle.getMapState("tries", "request string", "n int, until long")
        self.pending = handle.getListState("pending", EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = set(self.handle.listTimers())
        for r in rows:
            self.pending.appendValue((r.seq, r.request, r.action, r.at_ms, r.wait_ms))
            if r.at_ms not in known:
                known.add(r.at_ms)
                self.handle.registerTimer(r.at_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        events = [tuple(e) for e in self.pending.get()] if self.pending.exists() else []
        numbers = tuple(self.numbers.get()) if self.numbers.exists() else (0, 0, 0, 0)
        desk = Desk(base_limit(key[0]), *numbers, [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else [], {k[0]: tuple(v) for k, v in self.tries.iterator()} if self.tries.exists() else {})
        out = []
        for _, request, action, at, wait_ms in sorted((e for e in events if e[3] <= now), key=lambda e: (e[3], e[0])):
            out += desk.event(request, action, at, wait_ms)
        out += desk.pass_time(now)
        self._keep(desk, [e for e in events if e[3] > now])
        yield from (Row(model=key[0], request=o[0], outcome=o[1], at_ms=o[2], waited_s=o[3], used=o[4], permits=o[5]) for o in out)

    def _keep(self, desk: Desk, pending: list[tuple]) -> None:
        for state, values in ((self.pending, pending), (self.waiting, desk.waits())):
            state.clear()
            if values:
                state.put(values)
        self.tries.clear()
        for request, tried in desk.tries.items():
            self.tries.updateValue((request,), tried)
        if desk.used or desk.refusals:
            self.numbers.update((desk.used, desk.ends, desk.refusals, desk.refusals_end))
        else:
            self.numbers.clear()
        at = desk.next_change()
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def answers_on_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """answers() of a stream, each when the watermark has passed its time; events later than the watermark are left out.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    marked = _checked(events).withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    rows = marked.select("model", "ts", *(c.split()[0] for c in EVENT.split(", ")))
    return rows.groupBy("model").transformWithState(LimiterProcessor(), ANSWERS, "append", "eventTime")
