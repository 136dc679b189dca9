from __future__ import annotations

import collections
import math
import re
import zlib

import pytest

from foliant.llm import language_model as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("order", "small"), [(1, False), (2, True), (3, True), (4, False)])
def test_equals_a_sequential_automaton(documents, texts, monkeypatch, order, small):
    if small:
        monkeypatch.setattr(L, "BLOCK_BYTES", 60_000)
        monkeypatch.setattr(L, "SHARD_KEYS", 9_000)
        monkeypatch.setattr(L, "SEGMENT", 7)
    counts: collections.Counter = collections.Counter()
    total, tokens = 0, {}
    for i, t in texts.items():
        tokens[i] = [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)), "</s>"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            line = ["<s>"] * (order - 1) + tokens[i]
            for n in range(1, order + 1):
                counts.update(tuple(line[j - n + 1 : j + 1]) for j in range(order - 1, len(line)))
            for n in range(1, order):
                counts[("<s>",) * n] += 1
            total += len(tokens[i])
    types = sum(len(k) == 1 and k != ("<s>",) for k in counts)

    def walk(words):
        """States are n-grams; an arc's weight is the interpolated probability, a failure arc goes to the shorter state."""

        def arc(state, w):
            if not state:
                return (counts[(w,)] + 1) / (total + types + 1)
            return (counts[(*state, w)] + L.PRIOR * arc(state[1:], w)) / (counts[state] + L.PRIOR)

        state, score = ("<s>",) * (order - 1), 0.0
        for w in words:
            while state and not counts[(*state, w)]:
                score += math.log10(L.PRIOR / (counts[state] + L.PRIOR))
                state = state[1:]
            score += math.log10(arc(state, w))
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
            while state and not counts[state]:
                state = state[1:]
        return score

    got = {r.doc_id: r for r in L.scored(documents, order=order).collect()}
    assert len(got) == len(texts)
    for i, words in tokens.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(words), total)
        assert r.n_known == sum(counts[(w,)] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[(w,)] + 1) / (total + types + 1)) for w in words))
        assert r.score == pytest.approx(walk(words))


def test_held_out_texts_gain_by_context(documents):
    held = L.scored(documents).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert held.s > held.b


def test_packing_of_keys_and_counts():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (L.delta_unpacked(L.delta_packed(keys)) == keys).all()
    assert (L.delta_unpacked(L.delta_packed(keys[:1])) == keys[:1]).all()
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert L.counts_unpacked(L.counts_packed(counts), 6).tolist() == counts.tolist()


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    from foliant.llm.shingles import word_hashes

    texts = ["A b\tÄ b ", "", " a", "b", "x" * 300 + " " + "x" * 299 + "y", "x" * 300, "", "\x0b\x0c a\x1ca \u00a0", "ab cdefgh abcdefgh abcdefghi"]
    for column in (pa.array(texts), pa.array(["zz", *texts])[1:]):
        hashes, sizes = word_hashes(column)
        split = [t.encode().lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in split]
        words = [w for s in split for w in s]
        assert len(set(hashes.tolist())) == len(set(words))
        assert all((a == b) == (x == y) for a, x in zip(words, hashes) for b, y in zip(words, hashes))


def test_edges(edge, empty):
    rows = L.scored(edge).collect()
    assert len(rows) == edge.count()
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 1
    assert L.scored(empty).count() == 0
