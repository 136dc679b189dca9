"""Streams give what the same operators give on tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliant.streaming import events as E


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_on_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b", 1.5) for i in range(50)]
    schema = "id long, t string, event_type string, value double"
    stream = _stream(spark, rows, schema, str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t"))
    table = spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t"))
    got = _run(E.tumbling(stream, "10 minutes", "event_type"), "tumbled", "complete")
    want = E.tumbling(table, "10 minutes", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_arrivals_on_a_stream(spark, tmp_path):
    rows = [(1, "x", "p1", "2024-01-01 00:00:00"), (1, "x", "p2", "2024-01-01 00:01:00"), (2, "x", "p3", "2024-01-01 00:02:00"), (1, "y", "p4", "2024-01-01 00:03:00")]
    schema = "tenant_id int, md5 string, path string, t string"
    stream = _stream(spark, rows, schema, str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t")).drop("t")
    got = _run(E.fresh_files(stream), "fresh", "append")
    assert sorted((r.tenant_id, r.md5) for r in got.collect()) == [(1, "x"), (1, "y"), (2, "x")]


def test_permits_on_a_stream(spark, tmp_path):
    changes = [1, 1, 1, -1, 1, -1, -1, -1, 1]
    rows = [("k", i, f"2024-01-01 00:00:{i:02d}", c) for i, c in enumerate(changes)] + [("k", 20, "2024-01-02 00:00:00", 1)]
    stream = _stream(spark, rows, "key string, seq long, t string, change int", str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t")).drop("t")
    got = {r.seq: (r.used, r.admitted) for r in _run(E.permits(stream, 2, 3_600_000), "permits", "append").collect()}
    assert [got[i] for i in range(9)] == [(1, True), (2, True), (2, False), (1, False), (2, True), (1, False), (0, False), (0, False), (1, True)]
    assert got[20] == (1, True)


def test_admissions_on_a_table_are_those_of_the_stream(spark, tmp_path):
    """Random changes of some keys, one of them hot, in ranges so small that keys are cut many times."""
    rng = random.Random(3)
    keys = [rng.choice("aaaaaabc") for _ in range(600)]
    rows = [(k, i * 3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.choice((1, 1, -1))) for i, k in enumerate(keys)]
    schema = "key string, seq long, t string, change int"
    stream = _stream(spark, rows, schema, str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t")).drop("t")
    want = {(r.key, r.seq): (r.used, r.admitted) for r in _run(E.permits(stream, 3, 10**9), "permits_random", "append").collect()}
    table = spark.createDataFrame(rows, schema)
    got = {(r.key, r.seq): (r.used, r.admitted) for r in E.running(table, 3, partitions=60).withColumn("admitted", (F.col("change") > 0) & (F.col("before") < 3)).collect()}
    assert len(want) == 600 and got == want
    assert {(r.key, r.seq): (r.used, r.admitted) for r in E.admissions(table, 3).collect()} == want


def test_a_refused_acquisition_takes_no_permit(spark):
    rows = [("k", i, c) for i, c in enumerate((1, 1, 1, -1, 1))]
    got = E.admissions(spark.createDataFrame(rows, "key string, seq long, change int"), 2).orderBy("seq").collect()
    assert [(r.used, r.admitted) for r in got] == [(1, True), (2, True), (2, False), (1, False), (2, True)]


def test_permits_end_and_leave_the_state(spark, tmp_path):
    """A counter ends an hour after it rose from 0, and what is 0 or over is not kept."""
    at = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    rows = [("a", 0, at(0, 0), 1), ("a", 1, at(0, 50), 1), ("b", 2, at(0, 0), 1), ("b", 3, at(0, 1), -1), ("a", 4, at(1, 5), 1), ("c", 5, at(9, 0), 1)]
    folder = tmp_path / "in"
    schema = "key string, seq long, t string, change int"
    for part in (rows[:4], rows[4:5], rows[5:], [("c", 6, at(9, 1), 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.to_timestamp("t")).drop("t")
    query = E.permits(stream, 2, 3_600_000).writeStream.format("memory").queryName("permits_ending").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: (r.used, r.admitted) for r in spark.table("permits_ending").collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (1, True), 3: (0, False), 4: (1, True), 5: (1, True), 6: (2, True)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_hot_key_with_sparse_numbers_takes_no_longer(spark):
    """60,000 events of one key: the same answers for numbers next to each other and far apart, in about the same time."""
    import time

    changes = spark.range(60_000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.when(F.xxhash64("id") % 3 == 0, -1).otherwise(1).alias("change"))
    answers, seconds = [], []
    for far in (1, 10**9, 1, 10**9):
        start = time.perf_counter()
        out = E.admissions(changes.withColumn("seq", F.col("seq") * far), 5)
        answers.append([r.admitted for r in out.orderBy("seq").select("admitted").collect()])
        seconds.append(time.perf_counter() - start)
    assert answers[0] == answers[1] and sum(answers[0]) > 1000
    assert seconds[3] < 2 * seconds[2] + 1
