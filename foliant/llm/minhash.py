"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity.

Two permutations make a whole signature: the first deals a shingle to a place of the universe, the
second ranks places, and coordinate k takes the least rank after turning the second by k places.
Documents whose signatures agree on a band are candidates; similarity is confirmed on whole sets.

Pairs of a bucket are never all formed. Texts with equal word sequences count once. In each bucket
the member with the smallest share of shingles that no other candidate has is the hub, and every
member is compared with it, if it can be similar: an intersection has at most the shingles that a
side shares with any other candidate. Members that then are in another component than most of
their hub's members are compared with some further hubs, and those that still are with the others,
block by block, in tasks that hold an index of a block of outsiders and return a link for each
component that an outsider joins. Every candidate pair is thus linked, already connected, compared,
or shown to be too far apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, salted_join, small, written
from .components import connected_components
from .shingles import STEP, by_text, mix, shingle_set

#: 32 bands of 5: a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
UNIVERSE = 1 << 21
SEED = 7
#: Similarity as a fraction: linked if 5 * intersection >= 4 * union.
TOP, BOTTOM = 4, 5
CHUNK = 2048
#: Members of a hub's group in a block of outsiders, and in one that they are compared with.
OUTSIDE, INSIDE = 256, 512
#: Further hubs that the outsiders of a hub's group are compared with first.
MORE_HUBS = 8


@lru_cache(maxsize=2)
def permutations(universe: int, turns: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The dealing permutation, and a view whose row i holds the ranks of i, i + 1, ... around the circle."""
    rng = np.random.default_rng(seed)
    deal = rng.permutation(universe).astype(np.int32)
    rank = rng.permutation(universe).astype(np.int32)
    return deal, np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[: turns - 1]]), turns)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS, universe: int = UNIVERSE, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set of shingle hashes."""
    deal, turned = permutations(universe, coordinates, seed)
    places = deal[(shingles % np.uint64(universe)).astype(np.int64)]
    out = np.full(coordinates, universe, np.int32)
    for i in range(0, len(places), CHUNK):
        np.minimum(out, turned[places[i : i + CHUNK]].min(axis=0), out=out)
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = coordinates.astype(np.uint64).reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * STEP + parts[:, k])
    return keys.view(np.int64)


def text_key(words: np.ndarray) -> bytes | None:
    """What equal word sequences share; null without words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def node_of(key: bytes) -> int:
    """The number that stands for a word sequence in links and components."""
    return int.from_bytes(key[:8], "little", signed=True)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bands = [], [], []
            for words in by_text(batch.column(1)):
                keys.append(text_key(words))
                shingles = shingle_set(words, width)
                sizes.append(len(shingles))
                bands.append(band_keys(signature(shingles)) if len(words) else None)
            nodes = [None if k is None else node_of(k) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "n", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [w for w in by_text(batch.column(0)) if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(text_key(w)) for w in known], pa.int64()), pa.array([shingle_set(w, width).view(np.int64) for w in known], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) with shared, the exact size of the intersection of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared"))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(BOTTOM * F.col("shared") >= TOP * (F.col("na") + F.col("nb") - F.col("shared")))


def possible(na: str, nb: str, sa: str, sb: str) -> Column:
    """Whether sets of these sizes can be similar if they share at most sa and sb elements with anything."""
    most = F.least(F.col(sa), F.col(sb))
    return (BOTTOM * F.least(F.col(na), F.col(nb)) >= TOP * F.greatest(F.col(na), F.col(nb))) & ((TOP + BOTTOM) * most >= TOP * (F.col(na) + F.col(nb)))


def links(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(a, b): enough links between word sequences (reps: node, n, bands; doc_id of a row that has it) that components are those of all similar pairs."""
    rows = reps.select("node", "n", F.explode("bands").alias("bucket"))
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    members = written(rows.join(small(shared), "bucket", "left_semi"), "buckets")
    candidates = written(members.select("node").distinct().join(reps.select("node", "doc_id"), "node"), "candidates")
    whole = docs.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    sets = written(map_arrow(whole, _sets(width), "node long, shingles array<long>").join(candidates.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    lone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = written(lone.groupBy("node").agg(F.count("*").alias("own")), "own")
    members = members.join(own, "node", "left").select("bucket", "node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s"))
    members = written(members.where(BOTTOM * F.col("s") >= TOP * F.col("n")), "members")

    hubs = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "s"), F.struct(F.col("s") / F.col("n"), -F.col("node"))).alias("h"), F.count("*").alias("c")).where("c > 1")
    hubs = written(hubs.select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.s").alias("hub_s")), "hubs")
    star = members.join(hubs, "bucket").where("node <> hub").where(possible("n", "hub_n", "s", "hub_s"))
    star = star.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hub_n").alias("nb")).distinct()
    near = written(linked(compared(star, sets)).select("a", "b"), "stars")

    groups = written(members.join(hubs.select("bucket", "hub"), "bucket").select("hub", "node", "n", "s").distinct(), "groups")
    placed, mixed = outsiders(groups, near)
    if not mixed.count():
        return near
    helped = written(near.unionByName(by_more_hubs(placed, mixed, sets)), "helped")
    placed, mixed = outsiders(groups, helped)
    rest = written(met_in_blocks(placed.join(small(mixed), "hub"), sets), "rest")
    return helped.unionByName(rest)


def outsiders(groups: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups (hub, node, n, s) with component by the links of near; the hubs whose members are in several components: their
    main one, and the numbers of blocks that outsiders and members are dealt to)."""
    classes = written(connected_components(near), "classes")
    placed = written(groups.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = placed.groupBy("hub", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("hub").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("hub", "main", F.ceil((F.col("all") - F.col("most")) / OUTSIDE).cast("int").alias("lefts"), F.ceil(F.col("all") / INSIDE).cast("int").alias("rights"))
    return placed, written(mixed, "mixed")


def by_more_hubs(placed: DataFrame, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of outsiders with MORE_HUBS further members of their hub's main component.

    In a large group of near copies most outsiders are similar to one of them, so that few are left to meet in blocks.
    """
    rows = placed.join(small(mixed.select("hub", "main")), "hub")
    inside = rows.where("component = main and node <> hub")
    # the least by a hash in each of MORE_HUBS slots: an aggregate, so that no window has to order a large group
    chosen = inside.groupBy("hub", F.pmod(F.xxhash64("node"), F.lit(MORE_HUBS)).alias("slot")).agg(F.min_by(F.struct("node", "n", "s"), F.xxhash64("node", F.lit(1))).alias("h"))
    chosen = written(chosen.select("hub", F.col("h.node").alias("b"), F.col("h.n").alias("nb"), F.col("h.s").alias("sb")), "more_hubs")
    pairs = rows.where("component <> main").join(small(chosen), "hub").where(possible("n", "nb", "s", "sb"))
    return linked(compared(pairs.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").distinct(), sets)).select("a", "b")


def met_in_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of members outside their hub's main component with its other members.

    placed: hub, node, n, s, component, main, and the numbers of left and right blocks that a hub's
    members are dealt to. Each block of outsiders meets each block of members in one task.
    """
    columns = ("hub", "left", "right", "node", "component", "shingles")

    def dealt(rows: DataFrame, left: Column, right: Column) -> DataFrame:
        return rows.withColumn("left", left).withColumn("right", right).join(sets, "node").select(*[F.col(c).alias(c) for c in columns]).groupBy("hub", "left", "right")

    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    outside = dealt(placed.where("component <> main"), place("lefts"), every("rights"))
    return outside.cogroup(dealt(placed, every("lefts"), place("rights"))).applyInArrow(_meet, "a long, b long")


def _meet(outside: pa.Table, inside: pa.Table) -> pa.Table:
    """One link for each outsider and component that it is similar to, by an index of the outsiders' shingles."""
    pairs: list[tuple[int, int]] = []
    if outside.num_rows and inside.num_rows:
        docs, components = outside.column("node").to_numpy(), outside.column("component").to_numpy()
        lists = [np.array(x, np.int64) for x in outside.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in lists])
        everything = np.concatenate(lists)
        order = np.argsort(everything, kind="stable")
        owner = np.repeat(np.arange(len(lists)), sizes)[order]
        universe, starts, counts = np.unique(everything[order], return_index=True, return_counts=True)
        done: set[tuple[int, int]] = set()
        for doc, component, shingles in zip(inside.column("node").to_pylist(), inside.column("component").to_pylist(), inside.column("shingles").to_pylist()):
            own = np.array(shingles, np.int64)
            at = np.minimum(np.searchsorted(universe, own), len(universe) - 1)
            at = at[universe[at] == own]
            width = counts[at]
            ends = np.cumsum(width)
            if not len(at):
                continue
            places = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - width), width)
            shared = np.bincount(owner[places], minlength=len(lists))
            similar = (BOTTOM * shared >= TOP * (sizes + len(own) - shared)) & (components != component)
            for i in np.flatnonzero(similar).tolist():
                if (i, component) not in done:
                    done.add((i, component))
                    pairs.append((int(docs[i]), doc))
    columns = list(zip(*pairs)) or [(), ()]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def near_duplicates(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for every row.

    A document with fewer words than width has one shingle, its whole sequence; one without words or
    text has none, is linked with nothing and is kept. Rows with equal word sequences are linked. Rows
    are judged by their text: an id that comes with different texts is in the class of each. A row
    without doc_id is in no class and kept.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = written(map_arrow(rows, _signed(width), "doc_id long, text_hash long, node long, n long, bands array<long>"), "signed")
    known = signed.where("node is not null and doc_id is not null")
    reps = known.groupBy("node").agg(F.min_by(F.struct("doc_id", "n", "bands"), "doc_id").alias("r"), F.count("*").alias("copies"))
    reps = written(reps.select("node", "copies", "r.*"), "reps")
    classes = connected_components(links(rows, reps, width))
    notable = reps.select("node", "copies", "doc_id").join(classes, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    # a component goes by its least doc_id, which is not its least node
    least = notable.groupBy("component").agg(F.min("doc_id").alias("first"))
    notable = written(notable.join(least, "component").select("node", "first"), "notable")
    out = salted_join(signed.select("doc_id", "n", "node", "text_hash"), notable, "node", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, without those of a class that do not have its least id. Equal rows of an id and text stay once."""
    judged = written(near_duplicates(docs, width), "near")
    if judged.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    # by text as well, as an id may stay with one text and go with another
    dropped = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(small(written(dropped, "dropped")), gone, "left_anti")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of every document by four-word shingles; nulls, empty and repeated texts and empty tables as there."""
    return near_duplicates(documents(spark, sf_dir), width=4).drop("text_hash")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT r.node, e.b FROM r JOIN both_ways e ON r.other = e.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.node = n.doc_id
"""
