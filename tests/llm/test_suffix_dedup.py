from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from foliant.llm import suffix_dedup as S


def brute(rows: list[bytes]) -> list[tuple[int, int, int, str]]:
    first: dict[bytes, tuple[int, int]] = {}
    marks = [np.zeros(len(b), bool) for b in rows]
    for i, b in enumerate(rows):
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p : p + S.LENGTH]
            if w in first:
                j, q = first[w]
                marks[i][p : p + S.LENGTH] = True
                marks[j][q : q + S.LENGTH] = True
            else:
                first[w] = (i, p)
    out = []
    for b, m in zip(rows, marks):
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus() -> list[str]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdéß ") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    out = [text(80) + passage + text(20) for _ in range(25)]
    out += [other[:150] + text(5) + other, other, passage[:210], passage[:199], passage, passage, "é" * 500, "ab" * 400, "", "short"]
    base = text(200)
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("RUN_KEYS", 60), ("BLOCK_KEYS", 8), ("RANGE_KEYS", 25), ("GROUP_CLASSES", 2)):
            monkeypatch.setattr(S, name, value)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.repeated(df).select("doc_id", "text", "_spans", "_whole")
    got = {r.doc_id: tuple(r)[1:] for r in S.map_arrow(rows, S._removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_stretches_of_long_texts(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(b"abcdefgh ", k=5_000)), np.uint8)
    whole = [x.tolist() for x in S.anchors(data)]
    starts = sorted(p for a, lo, hi in zip(*whole[:3]) for p in range(a - hi, a - lo + 1))
    assert starts == list(range(len(data) - S.LENGTH + 1))


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(7)
    runs = []
    for r in range(7):
        keys = sorted({bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(rng.randrange(40))})
        if keys:
            shared = [0] + [S.common_prefix(a, b) for a, b in zip(keys, keys[1:])]
            cut = len(keys) // 2
            blocks = [(r << 32, S.front_coded(keys[:cut], shared[:cut], [1] * cut))] if cut else []
            runs.append((keys, S.Stream([*blocks, ((r << 32) + cut, S.front_coded(keys[cut:], shared[cut:], [1] * (len(keys) - cut)))])))
    merged = list(S.LoserTree([s for _, s in runs]))
    keys = [k for _, k, _, _ in merged]
    assert keys == sorted(k for ks, _ in runs for k in ks)
    assert [s for s, *_ in merged[1:]] == [S.common_prefix(a, b) for a, b in zip(keys, keys[1:])]


def test_edges(spark, edge, empty):
    rows = S.repeated(edge)
    assert rows.count() == edge.count()
    assert S.without_repeats(edge).columns == edge.columns
    assert S.without_repeats(empty).count() == 0
    repeats = spark.createDataFrame([(1, "z" * 250), (1, "z" * 250), (1, "y" * 199), (None, "q" * 300)], "doc_id long, text string")
    assert sorted(len(r.text) for r in S.without_repeats(repeats).collect()) == [0, 0, 0, 199]


def test_whole_characters():
    text = "aé".encode() * 3
    assert S.whole_characters(text, [(2, 5), (1, 3)]) == [(3, 4), (1, 3)]
