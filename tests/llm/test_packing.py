from __future__ import annotations

import zlib

import numpy as np
import pytest

from foliant.llm import packing as P


@pytest.fixture(scope="module")
def path():
    return P.production_tokenizer()


def test_ids_are_the_tokenizers(path, texts):
    encoder = P.encoder_of(path)
    more = ["", " ", "a\n\nb  c", "it's I'll", "x\ty", "é 日本 🙂", "z<|endoftext|>y", "\0", "1,2.3!?", "a" * 5_000]
    for t in [*texts.values(), *more]:
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_every_document_is_packed_whole(documents, texts, path):
    rows = P.packed_documents(documents, path).collect()
    ids = {i: np.array([*P.encoder_of(path).encode(t), 2], "<u4") for i, t in texts.items()}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.concatenate([[0], np.cumsum([r.length for r in parts])[:-1]]).tolist()
        assert sum(r.length for r in parts) == len(ids[i])
        assert all(r.length == P.CAPACITY for r in parts[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) for r in parts)
    check_sequences(rows)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * -(-total // P.CAPACITY) + 1


def check_sequences(rows, capacity=P.CAPACITY):
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 300)
    bins, offsets, count = P.best_fit_decreasing(lengths, 100)
    assert np.bincount(bins, lengths).max() <= 100 and bins.max() + 1 == count
    bound = P.lower_bound(lengths, 100)
    assert -(-lengths.sum() // 100) <= bound <= count
    # the plain rule: the fullest bin that fits, longest first
    room: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fitting = [(r, k) for k, r in enumerate(room) if r >= n]
        if fitting:
            room[min(fitting)[1]] -= n
        else:
            room.append(100 - n)
    assert sorted(100 - r for r in room) == sorted(np.bincount(bins, lengths).tolist())


def test_bound_sees_what_the_sum_does_not():
    assert P.lower_bound(np.array([60] * 10), 100) == 10
    assert P.lower_bound(np.array([34] * 9), 100) == 5
    assert P.lower_bound(np.zeros(0, np.int64), 100) == 0


def test_partitions_exchange_sequences(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(300, 700, 600))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = P.pack(df, pieces_per_task=40, exchanges=0).select("sequence_id").distinct().count()
    packed = P.pack(df, pieces_per_task=40).collect()
    assert len(packed) == 600
    check_sequences(packed)
    assert len({r.sequence_id for r in packed}) <= alone


def test_certificates(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(200, 800, 500)
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = P.pack(df, pieces_per_task=60)
    rows = packed.collect()
    check_sequences(rows)
    proof = P.certificate(packed)
    assert proof == {"sequences": len({r.sequence_id for r in rows}), "bound": P.lower_bound(lengths, P.CAPACITY), "gap": proof["sequences"] - proof["bound"]}
    assert proof["gap"] >= 0
    for r in rows:
        assert r.part_sequences >= r.part_bound >= 1
    values, times = np.unique(lengths, return_counts=True)
    assert P.lower_bound(values, 100, times) == P.lower_bound(lengths, 100)


def test_files_of_another_make_are_not_encoded_by_ranks(path):
    import json

    file = json.loads(P.encoder_of(path).tokenizer.to_str())
    tokens = 256 + len(file["model"]["merges"])
    assert P.encoder_of(path).plain is not None and P.merges_in_order(file, tokens)
    model = file["model"]
    merges = [*model["merges"][:-2], *model["merges"][:-3:-1]]
    assert not P.merges_in_order({**file, "model": {**model, "merges": merges}}, tokens)
    assert not P.merges_in_order({**file, "pre_tokenizer": None}, tokens)
    assert not P.merges_in_order(file, tokens + 1)


def test_edges(edge, empty, path):
    rows = P.packed_documents(edge, path).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    check_sequences(rows)
    assert P.packed_documents(empty, path).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "a", " \t", "é"])
def test_runs_of_two_million_of_a_kind_are_encoded(path, unit):
    encoder, text = P.encoder_of(path), "x" + unit * (2_000_000 // len(unit)) + "y"
    if unit in ("a", "é"):  # the tokenizer takes long for one word, so this holds the ids' bytes
        assert encoder.tokenizer.decode(encoder.encode(text[:20_000]).tolist()) == text[:20_000]
    else:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_white_space_of_any_length_is_packed(spark, path):
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "a"), (3, None)], "doc_id long, text string")
    rows = P.packed_documents(docs, path).collect()
    check_sequences(rows)
    ids = [*P.encoder_of(path).tokenizer.encode(" " * 2_000_000, add_special_tokens=False).ids, 2]
    assert sum(r.length for r in rows if r.doc_id == 1) == len(ids)
