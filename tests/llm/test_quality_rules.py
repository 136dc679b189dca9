from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from foliant.llm import quality_rules as Q


def brute(t: str) -> tuple[int, ...]:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    cover = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_base_measures(texts):
    more = ["", "a b c d e a b c d e", "x\ny\nx\n \n \n", "é\x0b日 #*", "a " * 9, "q w e r t y " * 40]
    for t in [*texts.values(), *more]:
        assert Q.measures(t.encode())[:5] == brute(t)


@pytest.mark.parametrize("vocabulary", [3, 10_000])
def test_repeated_words_with_large_vocabularies(vocabulary):
    ids = np.random.default_rng(0).integers(0, vocabulary, 3_000)
    ids[100:140], ids[2_000:2_040] = ids[500:540], ids[500:540]
    ids[-1] = 60_000
    words = ids.tolist()
    c = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
    want = {k for j in range(len(words) - 4) if c[tuple(words[j : j + 5])] > 1 for k in range(j, j + 5)}
    assert Q.repeated_words(ids) == len(want)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.02), (3, 1000, 0.01), (5, 5000, 0.002), (10, 10, 0.5)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert Q.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def _features(spark, rows):
    names = "doc_id long, stratum string, " + Q.FEATURES + ", row_key string"
    return spark.createDataFrame(rows, names)


def test_cutoffs_reject_bad_and_keep_their_promise(spark):
    # 3,000 good documents with few symbols, 500 bad ones with many; a second stratum with too few labels
    rows, labels = [], []
    for i in range(3_600):
        bad = i >= 3_000
        symbols = 60 if bad and i < 3_500 else i % 3
        stratum = "small" if i >= 3_500 else "big"
        rows.append((i, stratum, 100, 400, symbols, 0, 0, 0, 0, 0, 5, str(i)))
        labels.append((i, 0 if bad and i % 4 else 1, 0) if stratum == "small" else (i, int(not bad), 0))
    table = _features(spark, rows)
    chosen = Q.calibrate(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cutoffs = {r.stratum: r.cutoffs for r in chosen.collect()}
    assert cutoffs["small"] == {}
    assert set(cutoffs["big"]) == {"symbols_per_word"} and 0.02 < cutoffs["big"]["symbols_per_word"] < 0.6
    out = {r.doc_id: r for r in Q.judged(table, chosen).collect()}
    assert sum(not out[i].kept for i in range(3_000)) <= 0.02 * 3_000
    assert not any(out[i].kept for i in range(3_000, 3_500))
    assert all(out[i].kept for i in range(3_500, 3_600))


def test_strict_cutoffs_that_cost_good_documents_are_not_taken(spark):
    rows = [(i, "s", 100, 400, 0, 0, 0, 0, 0, (i % 100), 5, str(i)) for i in range(4_000)]
    labels = [(i, int(i % 100 < 60), 0) for i in range(4_000)]
    chosen = Q.calibrate(_features(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).first()
    assert chosen.cutoffs["echoes_share"] >= 0.6


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality(edge, labels).collect()
    assert len(out) == edge.count()
    assert {r.doc_id: r.kept for r in out if r.doc_id in (1, 2, 3, 4)} == {1: True, 2: False, 3: False, 4: False}
    assert Q.quality(empty, labels).count() == 0
    kept = Q.kept_documents(edge, labels)
    assert kept.columns == edge.columns and kept.where("doc_id is null").count() == 1


def test_equals_sql(spark, sf_dir, duck):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
    got = sorted(map(tuple, Q.op1_quality_rules(spark, sf_dir).select(*columns).collect()))
    assert got == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({Q.OP1_SQL})").fetchall())


def test_the_bound_is_on_what_the_base_rules_keep(spark):
    """Good documents that fail the base rules are not counted by the rules, and the report has both."""
    rows, labels = [], []
    for i in range(2_400):
        base_fails, bad = i < 200, i >= 2_200
        rows.append((i, "s", 100, 400, 50 if bad or base_fails else i % 3, 0, 40 if base_fails else 0, 0, 0, 0, 5, str(i)))
        labels.append((i, int(not bad), 0))
    table, marks = _features(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    chosen = Q.calibrate(table, marks)
    assert "symbols_per_word" in chosen.first().cutoffs
    report = Q.false_rejections(Q.judged(table, chosen), marks).collect()
    assert [(r.stratum, r.n_good, r.by_base, r.by_rules) for r in report] == [("s", 2_200, 200, 0)]
    assert report[0].share == pytest.approx(200 / 2_200)
