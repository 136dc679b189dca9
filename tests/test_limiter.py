"""Permits with waiting: the table and the stream give what a plain simulation second by second gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.streaming import limiter as L

SCHEMA = "model string, seq long, request string, action string, ts timestamp, wait_s double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def simulated(events, base, unit=1) -> list[tuple]:
    """Answers of one model, by looking at every second (unit: the parts of a second that are looked at)."""
    used = refusals = 0
    ends = window = -1
    queue, tries, out = [], {}, []
    by_time = {}
    for e in sorted(events, key=lambda e: (e[3], e[0])):
        by_time.setdefault(e[3], []).append(e)
    first, last = min(by_time), max(by_time) + 200 * unit

    def limit():
        return max(1, base // 2) if refusals >= 5 else base

    def serve(now):
        nonlocal used, ends
        while queue and used < limit():
            request, since, _ = queue.pop(0)
            used += 1
            ends = now + 60 * unit if used == 1 else ends
            out.append((request, "granted", now, (now - since) / unit, used, limit()))

    def expire(now):
        for w in [w for w in queue if w[2] <= now]:
            queue.remove(w)
            out.append((w[0], "refused", now, (now - w[1]) / unit, used, limit()))

    for now in range(first, last):
        expire(now)
        used = 0 if used and ends <= now else used
        refusals = 0 if refusals and window <= now else refusals
        tries = {k: v for k, v in tries.items() if v[1] > now}
        serve(now)
        for _, request, action, _, wait in by_time.get(now, []):
            expire(now)  # those that would not wait at all
            if action == "acquire":
                if used < limit():
                    used += 1
                    ends = now + 60 * unit if used == 1 else ends
                    out.append((request, "granted", now, 0.0, used, limit()))
                else:
                    queue.append((request, now, now + (60 if wait is None else int(wait)) * unit))
            elif action == "release":
                used = max(0, used - 1)
                tries.pop(request, None)
                serve(now)
            elif action == "refusal":
                window = now + 60 * unit if not refusals else window
                refusals += 1
                n = tries.pop(request, (0, 0))[0]
                if n < 3:
                    tries[request] = (n + 1, now + 60 * unit)
                out.append((request, "retry" if n < 3 else "failed", now, 2.0 * 2**n if n < 3 else 0.0, used, limit()))
        expire(now)
    return out


def random_events(seed: int, n: int, spread: int):
    rng = random.Random(seed)
    rows, at = [], 1_700_000_000
    for i in range(n):
        at += rng.choice([0, 0, 1, 1, 2, 5]) if rng.random() > 0.03 else rng.randrange(50, spread)
        action = rng.choices(["acquire", "release", "refusal", "noise"], [6, 4, 2, 0.2])[0]
        rows.append((rng.choice(["ocr", "ocr", "other"]), i, f"r{rng.randrange(8)}", action, at, rng.choice([None, 10.0, 3.0, 0.0])))
    return rows


def expected(rows):
    out = []
    for model in {r[0] for r in rows}:
        own = [(s, q, a, t, w) for m, s, q, a, t, w in rows if m == model]
        out += [(model, *o[:2], o[2] * 1000, *o[3:]) for o in simulated(own, L.base_limit(model))]
    return sorted(out)


def frame(spark, rows):
    plain = spark.createDataFrame(rows, "model string, seq long, request string, action string, t long, wait_s double")
    return plain.withColumn("ts", F.timestamp_seconds("t")).select(*(c.split()[0] for c in SCHEMA.split(", ")))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_equals_the_simulation(spark, seed):
    rows = random_events(seed, 500, 400)
    got = sorted(tuple(r) for r in L.answers(frame(spark, rows).repartition(3)).collect())
    assert got == expected(rows)
    assert {"granted", "refused", "retry"} <= {g[2] for g in got} and any(g[4] > 0 and g[2] == "granted" for g in got)
    assert len({g[6] for g in got if g[0] == "ocr"}) == 2


def test_query_equals_the_simulation(spark, sf_dir):
    from foliant.plans import arrivals as A

    events = A.events(spark, sf_dir).selectExpr(*A.LIMITED)
    rows = [(r.model, r.seq, r.request, r.action, r.ms, r.wait_s) for r in events.withColumn("ms", F.unix_millis("ts")).collect()]
    got = sorted(tuple(r) for r in A.permit_answers(spark, sf_dir).collect())
    want = []
    for model in {r[0] for r in rows}:
        want += [(model, *o) for o in simulated([r[1:] for r in rows if r[0] == model], L.base_limit(model), 1000)]
    assert got == sorted(want) and {"granted", "refused", "retry"} <= {g[2] for g in got}


def test_pauses_double_until_a_call_fails(spark):
    t = 1_700_000_000
    rows = [("text", i, "a", "refusal", t + 10 * i, None) for i in range(5)] + [("text", 9, "a", "refusal", t + 200, None)]
    got = [(r.outcome, r.waited_s) for r in L.answers(frame(spark, rows)).orderBy("at_ms").collect()]
    assert got == [("retry", 2.0), ("retry", 4.0), ("retry", 8.0), ("failed", 0.0), ("retry", 2.0), ("retry", 2.0)]


def test_halved_limit_grants_again_when_the_minute_ends(spark):
    t = 1_700_000_000
    rows = [("other", i, f"x{i}", "refusal", t, None) for i in range(5)] + [("other", 10 + i, f"a{i}", "acquire", t + 10 + i, 100.0) for i in range(4)]
    got = [(r.request, r.outcome, r.at_ms // 1000 - t, r.waited_s) for r in L.answers(frame(spark, rows)).orderBy("at_ms", "request").collect() if r.outcome != "retry"]
    assert got == [("a0", "granted", 10, 0.0), ("a1", "granted", 11, 0.0), ("a2", "granted", 60, 48.0), ("a3", "granted", 60, 47.0)]


def test_rows_without_model_request_or_time_and_empty_tables(spark):
    t = 1_700_000_000
    rows = [(None, 1, "a", "acquire", t, None), ("ocr", 2, None, "acquire", t, None), ("ocr", 3, "a", "acquire", None, None), ("ocr", 4, "b", None, t, None)]
    assert L.answers(frame(spark, rows)).collect() == []
    assert L.answers(frame(spark, []).limit(0)).collect() == []


def _stream(spark, folder, checkpoint, sink):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    writer = L.answers_on_stream(stream, "30 seconds").writeStream.format("parquet").option("checkpointLocation", str(checkpoint))
    query = writer.outputMode("append").trigger(availableNow=True).start(str(sink))
    query.awaitTermination(300)
    return query


def test_stream_equals_the_simulation_out_of_order_and_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = random_events(4, 120, 100)
        start, end = rows[0][4], rows[-1][4]
        rng = random.Random(1)
        # within 20 seconds of each other events come in any order
        arrived = sorted(rows, key=lambda r: r[4] + rng.uniform(0, 20))
        parts = [arrived[i : i + 30] for i in range(0, len(arrived), 30)]
        folder = tmp_path / "in"
        late = [("ocr", 10_000, "late", "acquire", start, None)]
        closing = [("ocr", 10_001, "z", "noise", end + 100_000, None), ("other", 10_002, "z", "noise", end + 100_000, None)]
        for part in parts[:2]:
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        _stream(spark, folder, tmp_path / "checkpoint", tmp_path / "out")
        for part in [*parts[2:], late, closing]:
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        query = _stream(spark, folder, tmp_path / "checkpoint", tmp_path / "out")
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == expected(rows)
        assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_long_queue_costs_no_pass_an_event():
    """20,000 requests wait at once and leave by their deadlines, by grants, or at the end; a pass over all at each event took minutes."""
    import time

    desk, out, began = L.Desk(5), [], time.time()
    for i in range(20_000):
        out += desk.event(f"r{i}", "acquire", i // 10, 50_000 + i % 7)
    for i in range(2_000):
        out += desk.event(f"r{i}", "release", 2_000 + i, None)
    while (at := desk.next_change()) is not None:
        out += desk.pass_time(at)
    assert len(out) == 20_000 and len({o[0] for o in out}) == 20_000
    assert [o[0] for o in out if o[1] == "granted"] == [f"r{i}" for i in range(2_005)]
    assert time.time() - began < 10
