"""A Merkle manifest of a dataset: a digest for each row, a root for all, and a proof for each row.

Rows are the leaves of one tree a source, and the sources' roots those of a last tree. Leaves get
places by a distributed sort and are cut into aligned blocks of 3^7. A first pass gives the root of
each block; the blocks' roots are again leaves of the same kind, so upper levels repeat it until one
node is left. On the way down a block's traversal emits the authentication paths of its leaves one
after the other, as fractal traversal does: its levels are cut into bands, each band keeps the nodes
of the subtree that the present path runs through and builds the next subtree by one leaf a step, so
what is held beside the leaves depends on the band, not on the block. The paths of the upper levels
are appended to those of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import documents, written
from .running import keyed, laid_out

ARITY = 3
#: Levels of a block: 2,187 leaves.
BLOCK_LEVELS = 7
#: Levels of a band of the traversal.
BAND = 2
#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(leaves: int) -> int:
    h, wide = 0, 1
    while wide < leaves:
        h, wide = h + 1, wide * ARITY
    return h


class Subtree:
    """The tree above some of a block's leaves, grown by one leaf a step; keeps its nodes of the levels low to high - 1.

    It stands under node number `index` of level high, or what there is of it at the block's end.
    """

    def __init__(self, leaves: list[str], index: int, low: int, high: int):
        self.leaves, self.low, self.high, self.index = leaves, low, high, index
        self.next = index * ARITY**high
        self.end = min(self.next + ARITY**high, len(leaves))
        self.kept: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root = leaves[self.next] if high == 0 else ""

    def step(self) -> None:
        if self.next >= self.end or not self.high:
            return
        node = self.leaves[self.next]
        self.next += 1
        for level in range(self.high):
            if level >= self.low:
                self.kept[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY and self.next < self.end:
                return
            node = digest(run)
            run.clear()
        self.root = node

    def whole(self) -> Subtree:
        while self.next < self.end and self.high:
            self.step()
        return self

    def beside(self, leaf: int, level: int) -> tuple[str, str]:
        """The siblings on the left and on the right of the leaf's node at level."""
        nodes = self.kept[level - self.low]
        at = leaf // ARITY**level - self.index * ARITY ** (self.high - level)
        first = at - at % ARITY
        return "".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf in turn, the lowest level first, as the siblings on either side."""
    bands = [(low, min(low + BAND, levels)) for low in range(0, levels, BAND)]
    existing = [Subtree(leaves, 0, *band).whole() for band in bands]

    def desired(b: int, index: int) -> Subtree | None:
        return Subtree(leaves, index, *bands[b]) if index * ARITY ** bands[b][1] < len(leaves) else None

    coming = [desired(b, 1) for b in range(len(bands))]
    for leaf in range(len(leaves)):
        yield [existing[level // BAND].beside(leaf, level) for level in range(levels)]
        for b, (_, high) in enumerate(bands):
            if coming[b]:
                coming[b].step()
            if (leaf + 1) % ARITY**high == 0 and coming[b]:
                existing[b], coming[b] = coming[b], desired(b, (leaf + 1) // ARITY**high + 1)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _roots(levels: int):
    wide = ARITY**levels

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        size, block = table["size"][0].as_py(), table["block"][0].as_py()
        root = Subtree(table["digest"].to_pylist(), 0, min(levels, height(size)), min(levels, height(size))).whole().root
        return pa.table({"tree": pa.array([table["tree"][0].as_py()], pa.string()), "pos": pa.array([block], pa.int64()), "size": pa.array([-(-size // wide)], pa.int64()), "digest": pa.array([root], pa.string())})

    return run


def climb(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """nodes (tree, pos, size of the tree, digest), then the roots of their blocks in the same columns, and so on to one node a tree."""
    chain = [nodes]
    while chain[-1].where("size > 1").limit(1).count():
        blocks = chain[-1].select("tree", "pos", "size", "digest", F.expr(f"pos div {ARITY**levels}").alias("block"))
        chain.append(written(blocks.groupBy("tree", "block").applyInArrow(_roots(levels), "tree string, pos long, size long, digest string"), "roots"))
    return chain


def _paths(levels: int, carried: list[str], given: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted(left)
        own = list(traversal(left["digest"].to_pylist(), min(levels, height(left["size"][0].as_py()))))
        above = [(x["left"], x["right"]) for x in right["path"][0].as_py()]
        steps = [step for path in own for step in (*path, *above)]
        offsets = np.arange(len(own) + 1, dtype=np.int32) * (len(steps) // len(own))
        sides = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], ["left", "right"])
        columns = {c: left[c] for c in carried} | {c: pa.repeat(right[c][0], len(own)) for c in given}
        return pa.table(columns | {"path": pa.ListArray.from_arrays(pa.array(offsets), sides)})

    return run


def descend(chain: list[DataFrame], above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The first table of a chain with `path` (its siblings up to the last table's nodes, then theirs), and above's other columns.

    above has tree, pos and path of the last table's nodes.
    """
    given = [c for c in above.columns if c not in ("tree", "pos", "path")]
    for nodes in reversed(chain[:-1]):
        carried = [f for f in nodes.schema.fields if f.name not in ("size", *given)]
        schema = StructType([*carried, *(above.schema[c] for c in given), StructField("path", PATH)])
        blocks = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).groupBy("tree", "block")
        paths = blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(_paths(levels, [f.name for f in carried], given), schema)
        above = paths if nodes is chain[0] else written(paths.drop("digest"), "paths")
    return above


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its length in bytes and its value, a null as '-'."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def _tree(source: Column) -> Column:
    """A name for the tree of each source that sorts by bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, path, subroot, root of every row, and columns of carry (narrow expressions over docs).

    Nulls have their own mark in a leaf, so a null and an empty text differ. Rows are ordered by source
    and doc_id (null first), rows that share an id by their leaf; equal rows each have a place. Texts of
    any length are hashed in the JVM and go no further. Columns other than FIELDS are left alone, whatever their
    names; an empty table gives an empty manifest.
    """
    carry = carry or {}
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tree(F.col("source")).alias("tree"), leaf(*fields).alias("digest"), F.lit(1).cast("long").alias("one"), *(e.alias(f"_c_{c}") for c, e in carry.items()))
    rows = written(rows, "leaves")
    sizes = written(rows.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
    placed = laid_out(rows, "tree", ["doc_id", "digest"], "one").withColumnRenamed("before", "pos").drop("one")
    trees = climb(written(keyed(placed, sizes, "tree", "pos"), "nodes"), levels)

    tops = written(trees[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "digest", F.lit(1).cast("long").alias("one")), "tops")
    sizes = written(tops.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
    tops = laid_out(tops, "tree", ["name"], "one").withColumnRenamed("before", "pos").drop("one")
    forest = climb(written(keyed(tops, sizes, "tree", "pos"), "forest"), levels)
    top = forest[-1].select("tree", "pos", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    proofs = descend(forest, top, levels) if len(forest) > 1 else forest[0].join(top.drop("path", "pos"), "tree").withColumn("path", F.array().cast(PATH))
    above = written(proofs.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "above")
    if len(trees) > 1:
        out = descend(trees, above, levels)
    else:
        out = trees[0].join(above.drop("pos"), "tree")
    return out.select("doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", *(F.col(f"_c_{c}").alias(c) for c in carry))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy without line breaks (every second id) still leads to the root.

    Nulls, empty and long texts, ties, repeats, empty tables and other columns as in manifest(); a row
    without doc_id is not tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf(*(text if c == "text" else F.col(c) for c in FIELDS))
    out = manifest(documents(spark, sf_dir), {"tampered": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a tree that the SQL goes up at most: 3^14 leaves a source.
SQL_LEVELS = 14


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, with the table t.crc of CRC_TABLE_SQL in reach."""
    bytes_of = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


#: The 256 remainders of crc32 by their rule.
CRC_TABLE_SQL = "SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc"


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels_sql(name: str) -> str:
    """name_i: the nodes of level i of the trees of name_0; name_s_i: what stands beside each of them; name_top: each tree's root."""
    out = []
    for i in range(SQL_LEVELS):
        out.append(f"{name}_s_{i} AS (SELECT tree, pos, coalesce(string_agg(d, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{i} WHERE size > 1 WINDOW l AS (PARTITION BY tree, pos // 3 ORDER BY pos))")
        out.append(f"{name}_{i + 1} AS (SELECT tree, pos // 3 AS pos, (size + 2) // 3 AS size, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}_{i} WHERE size > 1 GROUP BY tree, pos // 3, size)")
    out.append(f"{name}_top AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}_{i} WHERE size = 1" for i in range(SQL_LEVELS + 1)) + ")")
    return ",\n".join(out)


def _paths_sql(name: str, rows: str) -> str:
    """rows (tree, pos, proof, fold) after a walk up name's levels, as name_p."""
    out, last = [], rows
    for i in range(SQL_LEVELS):
        out.append(f"{name}_p_{i} AS (SELECT p.* REPLACE (p.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.tree IS NULL THEN p.fold ELSE sha256(s.l || p.fold || s.r) END AS fold) FROM {last} p LEFT JOIN {name}_s_{i} s ON s.tree = p.tree AND s.pos = p.pos // {ARITY**i})")
        last = f"{name}_p_{i}"
    return ",\n".join([*out, f"{name}_p AS (SELECT * FROM {last})"])


OP11_SQL = f"""
WITH t AS ({CRC_TABLE_SQL}),
d AS (SELECT documents.*, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents, t),
h AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf_sql("text")} AS d, {_leaf_sql("cut")} AS fold FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size, '' AS proof FROM h),
a_0 AS (SELECT tree, pos, size, d FROM a),
{_levels_sql("a")},
b_0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, d, tree AS name FROM a_top),
{_levels_sql("b")},
{_paths_sql("a", "a")},
q AS (SELECT p.doc_id, p.d AS leaf, p.proof, p.fold, b.d AS subroot, b.tree, b.pos FROM a_p p JOIN b_0 b ON b.name = p.tree),
{_paths_sql("b", "q")}
SELECT doc_id, leaf, subroot, b_top.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b_top.d AS verified FROM b_p, b_top
"""
