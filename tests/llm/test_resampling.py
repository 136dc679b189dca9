from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text) -> tuple[int, list[str]]:
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for _, text in table for f in features(text)[1]) for table in (rows, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in {*s, *t}}
    out = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def got(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS weight", "2 AS score", "3 AS rank", "4 AS bucket", "5 AS one")
    return sorted((tuple(r) for r in R.resampled(docs, spark.createDataFrame(target, "item_id long, text string")).collect()), key=str)


def random_rows(seed: int, n: int):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "x1", "ünï", "日本語", "🙂", "a_b", "don't", "A" * 70, "9", "İ", "ſ"]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "-", "\x00", " ", ". "]) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows, target = random_rows(seed, 400), random_rows(seed + 10, 20)
    assert got(spark, rows, target) == brute(rows, target)


def test_nulls_ties_repeats_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "one"), (None, text), (None, "other " + text), (4, text), (4, text), (4, text + " x"), (5, "Ab1 " * 1_500_000), (6, "z" * 5_000_000), (7, ("é" * 3_000_000 + " k ") * 2), (8, " \t\n...")]
    target = [(1, text), (2, None)]
    assert got(spark, rows, target) == brute(rows, target)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    rows = random_rows(3, 50)
    assert got(spark, rows, []) == brute(rows, [])


def test_long_texts_in_stretches_have_the_features_of_the_whole(monkeypatch):
    rng = random.Random(4)
    for limit in (1, 3, 10, 1000):
        for _ in range(50):
            text = "".join(rng.choice("abZ é-\n 9") for _ in range(rng.randrange(120)))
            monkeypatch.setattr(R, "BLOCK_BYTES", limit)
            monkeypatch.setattr(R.stretches, "__defaults__", (limit,))
            n, own = features(text)
            words, count, found, counts = R._row(text.encode(), 10000)
            assert (words, count) == (n, len(own))
            assert dict(zip(found.tolist(), counts.tolist())) == Counter(zlib.crc32(f.encode()) % 10000 for f in own)


def test_draws_in_proportion_to_the_weights(spark):
    """The draw has as many documents of the target's words as a draw without replacement by weight has on average."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(200)]
    topic = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(topic if i % 4 == 0 else common) for _ in range(80))) for i in range(800)]
    target = [(i, " ".join(rng.choice(topic) for _ in range(80))) for i in range(40)]
    out = sorted(got(spark, rows, target))
    drawn = [r[0] for r in out if r[4]]
    noise = np.random.default_rng(1).gumbel(size=(2000, 800)) * 1000
    simulated = np.argsort(-(np.array([r[2] for r in out]) + noise), axis=1)[:, :200] % 4 == 0
    share = simulated.mean(axis=1)
    assert len(drawn) == 200 and share.mean() > 0.4
    assert abs(np.mean([i % 4 == 0 for i in drawn]) - share.mean()) < 4 * share.std()
