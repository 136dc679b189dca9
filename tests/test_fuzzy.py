"""Similar lines against a comparison of every pair."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pandas as pd
import pytest

import __spark_entry__ as E
from foliant.operators import structure as S


def every_pair(rows, least):
    texts = {}
    for doc, zone, text in rows:
        texts.setdefault((doc, zone), set()).add(text)
    out = set()
    for key, found in texts.items():
        for a, b in combinations(sorted(found), 2):
            if (r := S.similarity(pd.Series([a]), pd.Series([b]))[0]) >= least:
                out.add((*key, a, b, round(r, 9)))
    return out


@pytest.mark.parametrize(("least", "small"), [(0.5, 0), (0.7, 0), (0.9, 0), (0.7, 30), (0.7, 500)])
def test_fuzzy_repeats_equals_every_pair(spark, least, small):
    rng, rows = random.Random(8), [(1, "header", ""), (1, "header", "a"), (1, "header", "b"), (1, "header", "ab")]
    for doc in (1, 2):
        for zone in ("header", "footer"):
            for _ in range(6):
                base = "".join(rng.choices("abcdefg 0123第页🙂", k=rng.choice([3, 8, 15, 16, 40])))
                for _ in range(6):
                    text = list(base)
                    for _ in range(rng.randrange(1 + len(text) // 2)):
                        text[rng.randrange(len(text))] = rng.choice(["", "x", "7", "第", "ab"])
                    rows.append((doc, zone, "".join(text)))
    got = [(*r[:4], round(r.ratio, 9)) for r in S.fuzzy_repeats(spark.createDataFrame(rows, "doc_id long, zone string, text string"), least, small).collect()]
    want = every_pair(rows, least)
    assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want


def test_no_blocks_are_matched_where_the_common_subsequence_is_too_short(monkeypatch):
    """Similarities as by matching blocks alone; of prose with the same characters in another order no blocks are matched."""
    import difflib

    rng, matched, plain = random.Random(4), [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: matched.append(1) or plain(self))
    for _ in range(400):
        a, b = ("".join(rng.choices("ab第🙂 ", k=rng.randrange(1, 90))) for _ in range(2))
        b = b if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.8) or "a"
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.longest_common(a, b) == table[-1][-1]
        full = S.similarity_of(a, b)
        assert S.similarity_of(a, b, 0.7) == full if full >= 0.7 else S.similarity_of(a, b, 0.7) < 0.7
    matched.clear()
    words = "".join(rng.choices("etaoinshrdlu ", k=300))
    assert S.similarity_of(words, "".join(rng.sample(words, 300)), 0.7) == 0.0 and not matched


def test_similarity_fuzzy_reads_every_header_line(spark, tmp_path):
    text = "\n".join(f"{'Annual report of the hospital, sheet' if k % 10 in (2, 3) else chr(65 + k % 10) * 9} {k}" for k in range(30))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.zone, r.a, r.b, round(r.ratio, 9)) for r in E.queries()["similarity_fuzzy"](spark, str(tmp_path)).collect()}
    lines = [(1, "header", x) for k, x in enumerate(text.split("\n")) if k % 10 < 4]
    assert got == every_pair(lines, 0.7) and any("Annual" in r[2] for r in got)


def similar(a, b, least):
    return S.similarity(pd.Series([a]), pd.Series([b]))[0] >= least


def cleaned(pages, least=0.7, most=50):
    """A plain fold over pages of (idx, text, y): lines that stay."""
    zone = lambda y: "header" if y / 3508 < 0.05 or y < 80 else "footer" if y / 3508 > 0.92 or y > 3388 else None
    number = lambda t: re.fullmatch(S.T.PAGE_NUMBER.replace("^", "").replace("$", ""), t) is not None
    if len(pages) < 3:
        return [(p, i) for p, lines in pages.items() for i, _, _ in lines]
    counts = {"header": {}, "footer": {}}
    for p in sorted(pages):
        for _, text, y in pages[p]:
            t, z = text.strip(), zone(y)
            if not t or z is None:
                continue
            known = counts[z]
            key = t
            if t not in known and not number(t) and len(known) < most:
                for k in known:
                    if similar(t, k, least):
                        key = k
                        break
            known[key] = known.get(key, 0) + 1
    often = {z: [k for k, n in known.items() if n >= max(2, int(len(pages) * 0.3))] for z, known in counts.items()}
    stays = []
    for p, lines in pages.items():
        for i, text, y in lines:
            t, z = text.strip(), zone(y)
            gone = bool(t) and z is not None and (often["header"] or often["footer"]) and (number(t) or any(similar(t, k, least) for k in often[z]))
            if not gone:
                stays.append((p, i))
    return stays


@pytest.mark.parametrize("most", [50, 3])
def test_similar_headers_go_as_in_a_fold(spark, most):
    rng = random.Random(5)
    rows, want = [], set()
    for doc, n in ((1, 8), (2, 2), (3, 12), (4, 5)):
        pages = {}
        for p in range(n):
            head = "".join(c if rng.random() > 0.08 else "x" for c in f"Bericht der Klinik, Blatt {p}")
            lines = [(0, head if doc != 4 else f"{'abcdefg'[p]}" * 9, 10), (1, rng.choice(["", " ", "z" * (p + 1)]), 50), (2, f"text {p}", 900), (3, head, 1200), (4, f"- {p} -", 3450), (5, rng.choice(["Fuß  links", "Fuss links", "q" * p]), 3460)]
            pages[p] = lines
            rows += [(doc, p, i, t, y) for i, t, y in lines]
        want |= {(doc, p, i) for p, i in cleaned(pages, most=most)}
    df = spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, y int")
    got = {(r.doc_id, r.page, r.idx) for r in S.without_similar_lines(df, most=most).collect()}
    assert got == want and len(want) < len(rows)


def test_query_removes_lines_that_differ_by_a_number(spark, sf_dir):
    """The query's result is that of a plain fold over each document, and not that of exact comparison."""
    from foliant.plans import structure as plans
    from foliant.plans.derived import blocks

    rows = blocks(spark, sf_dir).selectExpr(*plans.STAMPED)
    by_document: dict = {}
    for r in rows.orderBy("doc_id", "page", "idx").collect():
        by_document.setdefault(r.doc_id, []).append(r)
    want = set()
    for d, lines in by_document.items():
        pages = len({r.page for r in lines})
        known: dict = {"header": {}, "footer": {}}
        zone = lambda r: None if not r.text.strip(" \t\n\x0b\f\r\u3000") else "header" if r.y < 175.4 else "footer" if r.y > 3227.36 else None
        for r in lines:
            z, t = zone(r), r.text.strip(" \t\n\x0b\f\r\u3000")
            if z and pages >= 3:
                if t not in known[z]:
                    t = next((k for k in known[z] if S.similarity_of(t, k) >= 0.7), t)
                known[z][t] = known[z].get(t, 0) + 1
        often = {z: [k for k, c in known[z].items() if c >= max(2, int(pages * 0.3))] for z in known}
        for r in lines:
            z, t = zone(r), r.text.strip(" \t\n\x0b\f\r\u3000")
            if not (z and any(S.similarity_of(t, k) >= 0.7 for k in often[z])):
                want.add((d, r.page, r.idx))
    got = {(r.doc_id, r.page, r.idx) for r in plans.similar_line_removal(spark, sf_dir).collect()}
    assert got == want
    exact = {(r.doc_id, r.page, r.idx) for r in S.without_repeated_lines(rows).collect()}
    assert got < exact
