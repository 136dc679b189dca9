from __future__ import annotations

import random

import numpy as np
import pytest

from foliant.llm import components
from foliant.llm import minhash as M


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(15)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary[:12])
            rows.append(" ".join(words))
    rows += [None, "", "a", "A", "a b", "a b c d", "A  b\nc d", " \t", "x y z"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "small", "width"), [(1, False, 4), (2, True, 5)])
def test_equals_brute_force_among_near_copies(spark, monkeypatch, seed, small, width):
    if small:
        monkeypatch.setattr(M, "OUTSIDE", 7)
        monkeypatch.setattr(M, "INSIDE", 11)
        monkeypatch.setattr(M, "MORE_HUBS", 2)
    rows = near_copies(seed)
    got = {r.doc_id: tuple(r)[1:4] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    assert got == brute(rows, width)


def test_equals_brute_force_on_documents(documents, texts):
    got = {r.doc_id: tuple(r)[1:4] for r in M.near_duplicates(documents).collect()}
    assert got == brute(list(texts.items()), 5)


def test_an_id_with_several_texts_is_judged_by_each(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (3, c), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df).collect()))
    assert got == [(1, 1, True), (3, 3, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False)]
    assert sorted(map(tuple, M.one_of_each(df).collect()), key=str) == sorted([(1, a), (5, b), (3, c), (5, None)], key=str)


def test_coordinates_turn_one_permutation():
    shingles = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    deal, turned = M.permutations(M.UNIVERSE, 160, M.SEED)
    places = deal[(shingles % np.uint64(M.UNIVERSE)).astype(np.int64)].astype(np.int64)
    rank = turned[:, 0]
    want = [int(rank[(places + k) % M.UNIVERSE].min()) for k in range(160)]
    assert M.signature(shingles).tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = M.signature(np.concatenate([common, a])), M.signature(np.concatenate([common, b]))
    assert abs((x == y).mean() - 0.6) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 1), (300, 301)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(edge, empty):
    out = M.near_duplicates(edge).collect()
    assert len(out) == edge.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[3].kept and by_id[3].n_shingles == 0
    assert by_id[None].kept and by_id[None].component_id is None
    assert M.near_duplicates(empty).count() == 0
    kept = M.one_of_each(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.where("doc_id in (5, 6)").collect()) == [5]


def test_a_scope_deletes_what_was_written_in_it(spark, documents):
    import os

    from foliant.llm.common import scope, shared_folder, written

    folder = shared_folder(spark).removeprefix("file://") + "/foliant"
    outside = written(documents.select("doc_id"), "outside")
    before = set(os.listdir(folder))
    with scope(spark):
        n = M.near_duplicates(documents).count()
        assert set(os.listdir(folder)) > before
    assert n == documents.count() and set(os.listdir(folder)) == before and outside.count() == n
