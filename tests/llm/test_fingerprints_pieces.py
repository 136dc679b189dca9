from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import fingerprints as F7
from foliant.llm import pieces as P6


def bits(a: str, b: str) -> int:
    return bin(int(a, 16) ^ int(b, 16)).count("1")


@pytest.mark.parametrize(("range_rows", "levels"), [(30, (256, 4_096)), (10, (3, 2)), (5, (2, 16)), (1_000, (256, 4_096))])
def test_edited_texts_and_neighbours(documents, texts, monkeypatch, range_rows, levels):
    monkeypatch.setattr(F7.ranged, "__defaults__", (range_rows, *levels))
    monkeypatch.setattr(F7.in_ranges, "__defaults__", (range_rows, *levels))
    got = {r.doc_id: r for r in F7.edited_fingerprints(documents.select("doc_id", "text"), range_rows).collect()}
    ids = sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        t, part, r = texts[i], len(texts[i]) // 3, got[i]
        edited = t[: len(t) - part] + texts[j][:part]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(1 - bits(r.fingerprint, r.edited_fingerprint) / F7.BITS)
        assert r.near_next == pytest.approx(1 - bits(r.fingerprint, got[j].fingerprint) / F7.BITS)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


CLUSTERED = [*range(600), *[7] * 120, 10**15, 1 << 62, -(1 << 62), *[10**15 + 3 * i for i in range(80)]]


@pytest.mark.parametrize(("range_rows", "levels"), [(10, (4, 64)), (25, (256, 4_096)), (40, (1, 8)), (10_000, (256, 4_096))])
def test_ranges_rise_and_stay_small_with_clustered_and_repeated_ids(spark, range_rows, levels):
    """Dense ids with far ones on top, and an id that comes 121 times: no range outgrows its rows by much."""
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(CLUSTERED)], "id long, text string")
    got = F7.ranged(df, range_rows, *levels).orderBy("id", F7.F.shiftrightunsigned("hash", 1), "hash").collect()
    places = [(r.range1, r.range2, r.part) for r in got]
    assert places == sorted(places) and len(got) == len(CLUSTERED)
    if levels != (1, 8):
        assert max(collections.Counter(places).values()) <= 3 * range_rows


def test_neighbours_of_clustered_and_repeated_ids(spark):
    rows = [(i, f"text number {k} " * (1 + k % 4)) for k, i in enumerate(CLUSTERED)] + [(None, "no id"), (None, None), (7, "text number 7 "), (7, "text number 7 ")]
    got = F7.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert len(got) == len(rows)
    hashes = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").distinct().withColumn("h", F7.F.xxhash64("text")).collect()}
    order = sorted(((i if i is not None else -(1 << 63), hashes[t or ""] % (1 << 64), t or "") for i, t in rows), reverse=True)
    want = collections.Counter()
    for (i, _, t), (_, _, n) in zip(order, [*order[1:], order[0]]):
        part = len(t) // 3
        want[(None if i == -(1 << 63) else i, hashlib.sha256((t[: len(t) - part] + n[:part]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_no_python_in_the_plan(documents):
    prints = F7.edited_fingerprints(documents.select("doc_id", "text"))
    for df in (prints, F7.with_neighbours(prints)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct"))
        # no window without a partition
        assert all("partitionBy" in line or "[range" in line or "Window" not in line for line in plan.splitlines())


def test_counts_of_neighbours(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(12)]
    prints = [x ^ sum(1 << b for b in rng.sample(range(128), k % 5)) for x in base for k in range(10)]
    rows = [(i, f"{x:032x}") for i, x in enumerate([*prints, *prints[:7], 0, 0])] + [(None, f"{prints[3]:032x}"), (500, None)]
    got = F7.with_neighbours(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    every = {x for _, x in rows if x is not None}
    assert len(got) == len(rows)
    assert all(r.n_near == (sum(0 < bits(r.fingerprint, y) <= F7.RADIUS for y in every) if r.fingerprint else 0) for r in got)


def test_equal_and_weighted_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a  b\nc d e f"), (3, None), (4, ""), (5, "one"), (6, "a b c d e f " * 50), (7, "a b c d e g")]
    got = {r.doc_id: r.p for r in F7.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text", "p").collect()}
    assert got[1] == got[2] and got[3] == got[4] == "0" * 32 and got[5] != got[4]
    assert bits(got[1], got[6]) < bits(got[1], got[5])


def test_block_tables_find_every_pair(spark):
    rng = random.Random(3)
    prints = []
    for i in range(40):
        base = rng.getrandbits(128)
        prints.append(base)
        for _ in range(4):
            x = base
            for b in rng.sample(range(128), rng.randrange(7)):
                x ^= 1 << b
            prints.append(x)
    rows = [(i, f"{x:032x}") for i, x in enumerate(prints)] + [(999, f"{prints[0]:032x}"), (1000, None)]
    membership, pairs = F7.within_radius(spark.createDataFrame(rows, "doc_id long, fingerprint string"), 4)
    first = {}
    for i, x in sorted(rows):
        if x is not None:
            first.setdefault(x, i)
    keys = sorted(first, key=first.get)
    want = {(first[a], first[b], bits(a, b)) for k, b in enumerate(keys) for a in keys[:k] if bits(a, b) <= 4}
    assert {tuple(r) for r in pairs.select("a", "b", "bits").collect()} == want
    assert {r.doc_id: r["class"] for r in membership.collect()}[999] == 0


def test_fingerprint_edges(edge, empty):
    out = F7.edited_fingerprints(edge.select("doc_id", "text")).collect()
    assert len(out) == edge.count()
    assert F7.edited_fingerprints(empty.select("doc_id", "text")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return P6.Encoder(P6.production_model())


def viterbi(model, text):
    if not text:
        return []
    pieces = {model.out[int(i)].decode().replace(" ", P6.SPACE): (float(s), int(i)) for i, s in zip(model.ids, model.scores)}
    text = P6.SPACE + text.replace(" ", P6.SPACE)
    best = [(0.0, 0, [])] + [(-np.inf, 0, [])] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            part = text[start:end]
            if part in pieces:
                score, ids = pieces[part][0], [pieces[part][1]]
            elif end - start == 1:
                score, ids = model.unknown, [model.bytes[b] for b in part.encode()]
            else:
                continue
            if best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start, ids)
    out, end = [], len(text)
    while end:
        out, end = best[end][2] + out, best[end][1]
    return out


def test_equals_a_plain_viterbi(encoder, texts):
    samples = [t[:200] for t in list(texts.values())[:25]] + ["", "\n", "\n\n a", "a\n", "  x  y ", "日本語 テスト\n🙂", "\0a b", " " * 40, "x" * 90 + "é" * 30, "▁"]
    for s, ids in zip(samples, encoder.encode_batch(samples)):
        assert np.frombuffer(ids, "<u4").tolist() == viterbi(encoder.model, s)


def test_round_trips(documents, texts, edge, empty):
    path = P6.production_model()
    tokens = P6.encoded(documents, path)
    back = {r.doc_id: r.text for r in P6.decoded(tokens, path).collect()}
    assert back == texts
    again = {r.doc_id: r.text for r in P6.decoded(P6.encoded(edge, path), path).collect()}
    assert again[8] == "ünïcödé 日本語 🙂 text" and again[3] == "" and again[7] == "\t \n"
    assert P6.encoded(empty, path).count() == 0


def test_equals_sentencepiece(texts, spark):
    import sentencepiece

    path = P6.production_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    samples = [*texts.values(), "", "\n", "\n\n a", "a\n", "des Elle", "  x  y ", "日本語 テスト\n🙂", "\0a b", " " * 40, " " * 300 + "x", "x" * 90 + "é" * 30, "▁", "ｘ\u00a0y" * 40, "日本語テスト🙂" * 30]
    samples += ["".join(rng.choices("aeinrst  ▁\nﬁ語🙂", k=rng.randrange(120))) for _ in range(300)]
    for s, ids in zip(samples, P6.encoder_of(path).encode_batch(samples)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(s), s
    got = P6.encoded(spark.createDataFrame([(1, "des Elle")], "doc_id long, text string"), path).first()
    assert got.ids == sp.encode("des Elle")


def test_long_and_short_units_merge_alike():
    model, rng = P6.model_of(P6.production_model()), random.Random(6)
    for length in (1, 2, 3, 9, 30):
        units = ["".join(rng.choices("aeinrst▁語🙂0", k=length)) for _ in range(100)]
        assert model.encode_equal(units) == [model.encode_long(u) for u in units]


def test_many_near_copies_are_counted_without_pairs(spark, monkeypatch, tmp_path):
    """3,000 fingerprints that differ by few bits, in parts: counts as by brute force, and no table with more rows than the prefixes."""
    rng = np.random.default_rng(3)
    near = {0}
    while len(near) < 3000:
        near.add(int(sum(1 << int(b) for b in rng.choice(128, rng.integers(1, 4), replace=False))))
    prints = [f"{x:032x}" for x in near] + [f"{int(rng.integers(1, 1 << 62)) << 40:032x}" for _ in range(200)]
    prints = sorted(set(prints))
    rows_written = []
    monkeypatch.setattr(F7, "written", lambda df, name, inner=F7.written: (lambda out: (rows_written.append((name, out.count())), out)[1])(inner(df, name)))
    table = spark.createDataFrame([(i, f) for i, f in enumerate(prints)] + [(-1, prints[0]), (-2, None)], "doc_id long, fingerprint string")
    counts = {r.fingerprint: r.n_near for r in F7.neighbour_counts(table, rows_a_part=100).collect()}
    words = np.array([[int(f[k : k + 16], 16) for k in (0, 16)] for f in prints], np.uint64)
    want = {}
    for f, w in zip(prints, words):
        n = int((np.bitwise_count(words ^ w).sum(axis=1) <= F7.RADIUS).sum()) - 1
        if n:
            want[f] = n
    assert counts == want and max(want.values()) > 1000
    assert max(n for _, n in rows_written) <= 10 * len(prints)
    got = F7.with_neighbours(table).collect()
    assert all(r.n_near == want.get(r.fingerprint, 0) for r in got) and len(got) == len(prints) + 2


def test_frequencies_choose_the_best_segmentation(spark, documents, texts, edge, empty):
    """Counts as by a plain sum; the search over them as a plain one, also for units of many blocks; merges are never likelier."""
    path = P6.production_model()
    merging = P6.encoder_of(path)
    ids = [np.frombuffer(x, "<u4") for x in merging.encode_batch(list(texts.values()))]
    want = np.bincount(np.concatenate(ids), minlength=len(merging.model.out))
    counts = P6.piece_counts(documents, path)
    assert {r.piece: r.n for r in counts.collect()} == {int(i): int(want[i]) for i in np.flatnonzero(want)}
    scores = P6.log_probabilities(counts, path)
    assert np.allclose(np.exp(scores), (want + 1) / (want.sum() + len(want)))
    model = merging.model.with_scores(scores)
    assert type(model) is P6.PieceModel and merging.model.scores is not model.scores
    samples = [t[:150] for t in list(texts.values())[:20]] + ["", "\n\n a", "日本語 テスト\n🙂", "x" * 90 + "é" * 30, " " * 60]
    for s, got in zip(samples, P6.searcher_of(path, scores.tobytes()).encode_batch(samples)):
        assert np.frombuffer(got, "<u4").tolist() == viterbi(model, s), s
    rows = {r.doc_id: r for r in P6.searched(documents, path, scores).collect()}
    for k, (i, x) in enumerate(texts.items()):
        assert rows[i].log_prob >= scores[ids[k]].sum() - 1e-6
        assert merging.model.decode(rows[i].ids) == x
    odd = P6.searched(edge, path, scores).collect()
    assert len(odd) == edge.count() and all((not r.ids and r.log_prob == 0) == (r.doc_id in (2, 3)) for r in odd)
    assert P6.searched(empty, path, scores).count() == 0 and P6.piece_counts(empty, path).count() == 0
    assert np.allclose(np.exp(P6.log_probabilities(P6.piece_counts(empty, path), path)), 1 / len(want))


def test_long_units_in_blocks(monkeypatch):
    model, rng = P6.PieceModel(P6.production_model()), random.Random(8)
    units = ["".join(rng.choices("aeinrst▁語🙂0", k=n)) for n in (1, 7, 60, 400)]
    for block in (1, 3, 16, 1 << 14):
        monkeypatch.setattr(P6, "BLOCK", block)
        assert [model.encode_long(u) for u in units] == [model.encode_equal([u])[0] for u in units]


def test_units_are_decoded_once_and_odd_texts_whole(monkeypatch):
    """Texts whose units come back are not decoded one by one; the flags are those of whole decoding, also after the units start anew."""
    path, rng = P6.production_model(), random.Random(9)
    words = ["".join(rng.choices("aeinrst語🙂", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(40)] + ["a▁b", "▁", "", None, " " * 60, "\n a\n", "\0x"]
    rows = pa.table({"doc_id": range(len(texts)), "text": texts}).to_batches(max_chunksize=7)
    scores = np.log(np.arange(1.0, len(P6.encoder_of(path).model.out) + 1)).tobytes()
    decoded, plain = [], P6.PieceModel.decode
    monkeypatch.setattr(P6.PieceModel, "decode", lambda self, ids: decoded.append(ids) or plain(self, ids))
    want = None
    for most in (P6.CACHE_UNITS, 10):
        monkeypatch.setattr(P6, "CACHE_UNITS", most)
        got = [r for b in P6._digest(path, scores)(iter(rows)) for r in b.to_pylist()]
        assert want is None or got == want
        want = got
    assert len(decoded) < len(texts)
    model = P6.encoder_of(path).model
    for r, t, ids in zip(want, texts, P6.Encoder(path, model).encode_batch([t or "" for t in texts])):
        assert r["round_trip"] == (plain(model, np.frombuffer(ids, "<u4").tolist()) == (t or "")) and r["n_pieces"] * 4 == len(ids)
