from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row) -> str:
    i, text, lang, source, n = row
    return h(*(field(x) for x in (i, source, lang, n, text)))


def levels_of(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    path = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return path


def brute(rows) -> list[tuple]:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    trees = {s: levels_of([leaf_of(r) for r in own]) for s, own in ordered.items()}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, row in enumerate(ordered[s]):
            path = path_of(trees[s], at) + path_of(top, k)
            hit = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            fold = leaf_of((row[0], row[1].replace("\n", ""), *row[2:])) if hit else leaf_of(row)
            for left, right in path:
                fold = h(left, fold, right)
            out.append((row[0], leaf_of(row), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in path)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def rows_of(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_traversal_gives_every_path_with_bounded_memory():
    for n in [*range(1, 85), 243, 244, 700]:
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        assert list(M.traversal(leaves, M.height(n))) == [path_of(levels, i) for i in range(n)]
        # under a larger tree a last block goes up to the blocks' level by runs of one
        higher = levels + [[h(levels[-1][0])]]
        assert list(M.traversal(leaves, M.height(n) + 1)) == [path_of(higher, i) for i in range(n)]
    assert list(M.traversal(["a"], 0)) == [[]]
    held = M.Subtree([h(str(i)) for i in range(3**7)], 0, 2, 4).whole()
    assert sum(map(len, held.kept)) == 12 and not any(held.open)


@pytest.mark.parametrize(("seed", "levels"), [(1, 1), (2, 2)])
def test_equals_brute_force_over_many_blocks(spark, tmp_path, monkeypatch, seed, levels):
    monkeypatch.setattr(M, "manifest", lambda docs, carry, inner=M.manifest: inner(docs, carry, levels))
    rng = random.Random(seed)
    sources = [None, "", "a", "ä", "z", "b", "hot", *(f"one{i}" for i in range(rng.randrange(4, 12)))]
    rows = [(i, rng.choice(["a\nb", "", "plain", "\n", None, "日本\n"]), "en", "hot" if rng.random() < 0.5 else rng.choice(sources), 5) for i in range(400)]
    rng.shuffle(rows)
    assert rows_of(spark, tmp_path, rows) == brute(rows)


def test_nulls_long_texts_ties_repeats_and_clashing_names(spark, tmp_path):
    rows = [
        (1, "a\n" * 2_000_000, "en", "s", 4_000_000), (2, None, None, None, None), (None, "no\nid", "en", "s", 5), (None, "no id", "en", "s", 5),
        (3, "same", "en", "s", 4), (3, "same", "en", "s", 4), (3, "other\ntext", "en", "s", 4), (4, "-", "", "", 0), (-5, "négatif\n", "fr", None, 8),
    ]
    assert rows_of(spark, tmp_path, rows, ("leaf", "tree", "pos", "size", "digest", "path", "root", "subroot", "one", "name", "block")) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    row = (7, "x\ny", "en", "s", 3)
    assert rows_of(spark, tmp_path, [row]) == brute([row])
    assert rows_of(spark, tmp_path, []) == []


def test_a_proof_of_another_row_or_text_does_not_lead_to_the_root(spark, documents):
    rows = M.manifest(documents).limit(50).collect()
    for r, other in zip(rows, rows[1:]):
        def fold(node, path):
            for step in path:
                node = h(step.left, node, step.right)
            return node
        assert fold(r.leaf, r.path) == r.root
        assert fold(r.leaf, other.path) != r.root and fold(other.leaf, r.path) != r.root


def test_crc32_in_sql():
    texts = ["", "0", "-1", "9223372036854775807", "ünï 🙂"]
    rows = ", ".join(f"('{x}')" for x in texts)
    got = duckdb.sql(f"WITH t AS ({M.CRC_TABLE_SQL}) SELECT x, {M.crc32_sql('x')} FROM (VALUES {rows}) v(x), t").fetchall()
    assert dict(got) == {x: zlib.crc32(x.encode()) for x in texts}
