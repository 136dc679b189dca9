from __future__ import annotations

import zlib

import numpy as np
import pytest
import test_minhash
import test_pii

import corpus_pipeline as C
from foliant.llm import packing, pii, quality_rules, suffix_dedup


@pytest.fixture(scope="module")
def staged(spark, sf_dir, documents):
    """The rows that each stage reads, then the last stage's."""
    docs, out = documents, [documents.select(*C.COLUMNS).collect()]
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
        assert name == "packing" or tuple(docs.columns) == C.COLUMNS
    return out


def by_id(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_and_counts(staged):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    sizes = [len(x) for x in staged]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > 0
    assert all(r.n_chars == len(r.text) for rows in staged[3:5] for r in rows)


def test_quality_equals_its_sql(staged, duck):
    kept = duck.sql(f"SELECT doc_id FROM ({quality_rules.OP1_SQL}) WHERE kept").fetchall()
    assert sorted(r.doc_id for r in staged[1]) == sorted(i for (i,) in kept)
    assert set(by_id(staged[1]).items()) <= set(by_id(staged[0]).items())


def test_near_duplicates_equal_brute_force(staged):
    texts = by_id(staged[1])
    kept = {i for i, (_, _, first) in test_minhash.brute(list(texts.items()), 5).items() if first}
    assert by_id(staged[2]) == {i: texts[i] for i in kept}


def test_repeated_passages_equal_brute_force(staged):
    bodies = {i: t.encode() for i, t in by_id(staged[2]).items()}
    length, seen = suffix_dedup.LENGTH, {}
    marks = {i: np.zeros(len(b), bool) for i, b in bodies.items()}
    for i, b in bodies.items():
        for p in range(len(b) - length + 1):
            window = b[p : p + length]
            if window in seen:
                j, q = seen[window]
                marks[i][p : p + length] = marks[j][q : q + length] = True
            else:
                seen[window] = (i, p)
    got = by_id(staged[3])
    assert any(m.any() for m in marks.values())
    for i, b in bodies.items():
        # a character stays whole unless all of its bytes are repeated in one stretch
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            text += "" if marks[i][at : at + n].all() else c
            at += n
        assert got[i] == text


def test_personal_data_is_gone_and_the_rest_stays(staged):
    before, after = by_id(staged[3]), by_id(staged[4])
    changed = 0
    for i, text in before.items():
        plain = test_pii.brute(text)
        for spans in plain.values():
            for a, b in spans:
                assert text[a:b] not in after[i]
        assert not any(pii.find(after[i])[1].values())
        if not any(plain.values()) and not any(test_pii.hinted(text)):
            assert after[i] == text
        changed += after[i] != text
    assert changed


def test_sequences_hold_every_token(staged):
    encoder = packing.encoder_of(packing.production_tokenizer())
    pieces: dict = {}
    for r in staged[5]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == by_id(staged[4]).keys()
    for i, text in by_id(staged[4]).items():
        ids = np.array([*encoder.encode(text), packing.END_ID], "<u4")
        parts = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
    filled: dict = {}
    for r in staged[5]:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY


def test_run_on_hard_rows(spark, edge, tmp_path):
    edge.select(*C.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 5, None}
    assert all(r.length > 0 for r in rows)
    docs = edge  # more columns, whose names the operators use themselves
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, str(tmp_path)), name)
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == sorted(map(str, (r.doc_id for r in rows)))
