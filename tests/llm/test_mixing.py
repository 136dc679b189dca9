from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def point(k: int, m: int) -> int:
    return int(format(k, f"0{m}b")[::-1], 2) if m else 0


def targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    """By repeated sharing of the excess, as the task says."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    out, open_, left = dict.fromkeys(keys, 0.0), set(keys), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        whole = sum(weight[k] for k in open_)
        add = {k: left * weight[k] / whole for k in open_}
        left = 0.0
        for k, x in add.items():
            out[k] += x
            if out[k] >= 3 * sizes[k]:
                left += out[k] - 3 * sizes[k]
                out[k] = 3.0 * sizes[k]
                open_.discard(k)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    sources = ["hot", "tiny", None, "", "a", "b", "c"]
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 60))), "en", s, 0))
    return rows + [(n, "x", "en", "one word", 1), (n + 1, None, "en", "no words", 0)]


@pytest.mark.parametrize(("keys", "quotas"), [(1, [100]), (3, [50, 1, 49]), (5, [0, 3, 700, 9, 0]), (2, [1, 1])])
@pytest.mark.parametrize("m", [3, 6, 10])
def test_schedule_is_van_der_corputs(spark, keys, quotas, m):
    cum = [sum(quotas[: i + 1]) for i in range(keys)]
    rows = [(str(i), i, quotas[i], cum[i], cum[-1], keys) for i in range(keys)]
    sources = M.with_cells(spark.createDataFrame(rows, "key string, nth long, quota long, cum_quota long, all_quota long, n_keys long"), m)
    parts = {r.key: (r.low, r.high) for r in sources.collect()}
    want, ranks = {}, defaultdict(int)
    for k in range(2**m):
        key = next(s for s, (low, high) in parts.items() if low <= point(k, m) < high)
        want[k] = (key, ranks[key])
        ranks[key] += 1
    got = {r.slot: (r.key, r["rank"]) for r in M.schedule(sources, m).collect()}
    assert got == want
    for i in range(keys):
        assert ranks[str(i)] >= 1 and abs(ranks[str(i)] - 2**m * quotas[i] / cum[-1]) <= keys + 1


def test_chunks_of_slots_go_on_where_the_last_ended(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 8)
    rows = [("a", 0, 30, 30, 40, 2), ("b", 1, 10, 40, 40, 2)]
    sources = M.with_cells(spark.createDataFrame(rows, "key string, nth long, quota long, cum_quota long, all_quota long, n_keys long"), 7)
    assert sorted(r.slot for r in M.schedule(sources, 7).collect()) == list(range(128))


@pytest.mark.parametrize(("seed", "block_words"), [(1, 1024), (2, 16), (3, 1)])
def test_takes_the_targets_in_whole_blocks(spark, seed, block_words):
    rows = random_rows(seed)
    mix = M.Mix(frame(spark, rows), block_words=block_words)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken, got_target = defaultdict(int), {}
    out = mix.taken().collect()
    assert sorted(r.doc_id for r in out) == sorted(source_of)
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and 0 <= r.taken <= 3 * r["size"]
        assert (r.first_slot is None) == (r.taken == 0)
        taken[s] += r.taken
        got_target[s] = r.target
    for s in sizes:
        assert got_target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    pieces = mix.pieces().collect()
    filled, covered = defaultdict(int), defaultdict(list)
    for p in pieces:
        filled[p.slot] += p.length
        covered[p.doc_id, p.epoch].append((p.start, p.length))
    per_source = defaultdict(set)
    for p in pieces:
        per_source[p.key].add(p.slot)
    for slots in per_source.values():
        words = [filled[s] for s in slots]
        assert max(words) - min(words) <= 1
    for spans in covered.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length


def test_prefixes_of_the_mix_keep_the_proportions(spark):
    mix = M.Mix(frame(spark, random_rows(5, 2000)), block_words=32)
    parts = {r.key: r.slots / 2**mix.m for r in mix.sources.collect()}
    order = [r.key for r in mix.slots.orderBy("slot").collect()]
    assert len(order) == 2**mix.m >= 512
    for n in range(64, len(order), 37):
        for key, share in parts.items():
            assert abs(order[:n].count(key) - share * n) <= 2 + mix.m / 2


def test_reruns_agree(spark):
    rows = random_rows(4)
    one = M.Mix(frame(spark, rows)).taken().collect()
    random.Random(1).shuffle(rows)
    two = M.Mix(frame(spark, rows).repartition(7)).taken().collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_edges(spark, edge, empty, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op12_source_mix(spark, str(tmp_path)).collect()
    assert len(out) == edge.count()
    assert {r["size"] for r in out if r.doc_id in (2, 3, 7)} == {0}
    assert sum(r.taken for r in out) == sum(r["size"] for r in out)
    assert M.Mix(empty).taken().collect() == []
    nothing = M.Mix(spark.createDataFrame([(1, None, "en", "a", 0), (2, " \n", "en", None, 2)], SCHEMA)).taken()
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


def test_a_hot_key_is_laid_out_in_parts(spark):
    from foliant.llm.common import written
    from foliant.llm.running import laid_out

    rows = spark.range(20_000).select(F.lit("k").alias("key"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("n"))
    out = laid_out(written(rows, "rows"), "key", ["x"], "n").orderBy("before", "x").collect()
    at = 0
    for r in out:
        assert r.before <= at
        at = max(at, r.before + r.n)
    assert at == sum(i % 3 for i in range(20_000))
    assert [r.x for r in out] == sorted(r.x for r in out)
