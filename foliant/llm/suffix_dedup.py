"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte is repeated if some string of LENGTH bytes that covers it also starts anywhere else. Sorting
every suffix is not needed to know: each string of LENGTH bytes contains an anchor, the GRAM-byte
string of least hash in it (the rightmost of equals), chosen by the string's bytes alone. Equal
strings thus have equal anchors at equal places, and it is enough to sort the suffixes that start
at anchors, each with the bytes before it, as far as the strings reach that the anchor stands for.

1. Anchors are found with rolling hashes; those whose hash is unique in the corpus are dropped (a
   distributed duplicate detection, as prefix-doubling string sorters do it).
2. Each task sorts the suffixes of the anchors left to it into runs, equal ones collapsed into a class
   with its places, and front-codes them: a length shared with the one before, and the rest.
3. Runs are cut at splitters of a regular sample and exchanged, and each key range is merged by a
   loser tree that carries common prefix lengths, so no prefix is compared twice.
4. The merged order gives classes of equal contexts: all strings of a class with two places or more
   are repeated. Classes with one place can still share some strings with others under the same
   anchor; those are told apart by 128-bit digests, in the range or, for large groups and those that
   a splitter cuts, by an exchange of their own.

Equal texts are settled before, by digest: all their strings are repeated, and one of them stands for
all in the sort. What one task holds is bounded by run and range sizes however hot a passage is.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, documents, map_arrow, raw, salted_join, small, written
from .shingles import mix

LENGTH, GRAM = 200, 48
#: Bytes of text hashed at once; longer texts are taken in overlapping stretches of it.
STRETCH = 1 << 20
PLACES = 21
#: Suffixes of a run, of a block of it, of a key range, and classes of a group compared within a task.
RUN_KEYS, BLOCK_KEYS, RANGE_KEYS, GROUP_CLASSES = 200_000, 1024, 60_000, 4_000
#: Keys that the driver takes as a sample for the splitters.
SAMPLE_KEYS = 1 << 18
#: Bits of a class's number for its place in a run, and for the run in its partition.
PLACE_BITS, RUN_BITS = 28, 13
ODD = 0x9E3779B97F4A7C15
MASK = np.uint64((1 << PLACES) - 1)
SPAN = LENGTH - GRAM + 1


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and the powers of an odd number and of its inverse modulo 2**64."""
    values = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    out = []
    for base in (ODD, pow(ODD, -1, 1 << 64)):
        p = np.full(STRETCH + LENGTH, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return values, out[0], out[1]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high, hash) of the anchors of one stretch; an anchor at a stands for the strings that start at a - high .. a - low."""
    values, powers, inverse = tables()
    n = len(data)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers[:n], out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    m = len(hashes)
    ranked = (hashes & ~MASK) | (MASK - np.arange(m, dtype=np.uint64))
    blocks = -(-m // SPAN)
    padded = np.full(blocks * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = ranked
    square = padded.reshape(blocks, SPAN)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = m - SPAN + 1
    least = np.minimum(after[:strings], before[SPAN - 1 : SPAN - 1 + strings])
    place = (MASK - (least & MASK)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [strings]]) - 1
    at = place[first]
    return at, at - last, at - first, hashes[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        found: list[tuple] = []
        count = 0

        def made() -> pa.RecordBatch:
            sizes = [len(f[1]) for f in found]
            tid = np.repeat(np.array([f[0] for f in found], np.int64), sizes)
            return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]).view(np.int64))], ["tid", "anchor", "hash"])

        for tid, text in zip(ids, raw(batch.column(1))):
            data = np.frombuffer(text, np.uint8)
            for start in range(0, max(1, len(data) - LENGTH + 1), STRETCH):
                at, low, high, hashes = anchors(data[start : start + STRETCH + LENGTH - 1])
                if len(at):
                    found.append((tid, ((at + start) << 16) | (low << 8) | high, hashes))
                    count += len(at)
            if count > 200_000:
                yield made()
                found, count = [], 0
        if found:
            yield made()


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which known bytes are known to be equal."""
    most = min(len(a), len(b))
    step = 16
    while known < most:
        end = min(known + step, most)
        if a[known:end] == b[known:end]:
            known, step = end, step * 2
            continue
        while end - known > 1:
            middle = (known + end) // 2
            if a[known:middle] == b[known:middle]:
                known = middle
            else:
                end = middle
        return known
    return most


def key_of(text: bytes, at: int, low: int, high: int) -> bytes:
    """The suffix at an anchor as far as its strings reach, then the bytes before it backwards, then how far both go."""
    return text[at : at + LENGTH - low] + text[at - high : at][::-1] + bytes((low, high))


def context_of(key: bytes) -> tuple[bytes, int, int]:
    """The bytes around an anchor in order, and low and high."""
    low, high = key[-2], key[-1]
    right = LENGTH - low
    return key[right:-2][::-1] + key[:right], low, high


def front_coded(keys: list[bytes], shared: list[int], counts: list[int]) -> bytes:
    """Sorted keys as shared lengths and rests; shared[0] is not used, as a block stands for itself."""
    shared = [0, *shared[1:]]
    rests = [k[s:] for k, s in zip(keys, shared)]
    head = np.array([len(keys)], "<u4").tobytes() + np.array(shared, "<u2").tobytes() + np.array([len(r) for r in rests], "<u2").tobytes() + np.array(counts, np.uint8).tobytes()
    return zlib.compress(head + b"".join(rests), 1)


def front_decoded(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(shared, key, count) of each key of a block."""
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    shared = np.frombuffer(data, "<u2", n, 4).tolist()
    sizes = np.frombuffer(data, "<u2", n, 4 + 2 * n).tolist()
    counts = data[4 + 4 * n : 4 + 5 * n]
    at, key = 4 + 5 * n, b""
    for s, size, c in zip(shared, sizes, counts):
        key = key[:s] + data[at : at + size]
        at += size
        yield s, key, c


RUNS = "first binary, last binary, id long, n int, data binary, classes array<long>, tids array<long>, places array<long>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of the suffixes at the anchors of texts, block by block."""
    run = first_run = TaskContext.get().partitionId() << RUN_BITS
    keys: list[bytes] = []
    tids: list[int] = []
    places: list[int] = []

    def sorted_run(number: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        if number - first_run >> RUN_BITS or len(order) >> PLACE_BITS or number >> 63 - PLACE_BITS:
            raise ValueError("a partition has too many runs, or a run too many keys, for the numbers of classes")
        base, position = number << PLACE_BITS, 0
        block: list[bytes] = []
        shared: list[int] = []
        counts: list[int] = []
        members: tuple[list[int], list[int], list[int]] = ([], [], [])

        def made() -> pa.RecordBatch:
            row = {"first": block[0], "last": block[-1], "id": base + position, "n": len(block), "data": front_coded(block, shared, counts), "classes": members[0], "tids": members[1], "places": members[2]}
            return pa.RecordBatch.from_pylist([row], schema=RUN_ARROW)

        previous = None
        for i in order:
            key = keys[i]
            if key != previous:
                if len(block) == BLOCK_KEYS:
                    yield made()
                    position += len(block)
                    block, shared, counts, members = [], [], [], ([], [], [])
                shared.append(common_prefix(block[-1], key) if block else 0)
                block.append(key)
                counts.append(0)
                previous = key
            counts[-1] = min(2, counts[-1] + 1)
            members[0].append(base + position + len(block) - 1)
            members[1].append(tids[i])
            members[2].append(places[i])
        if block:
            yield made()

    for batch in batches:
        for tid, text, found in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist()):
            for packed in found:
                at, low, high = packed >> 16, packed >> 8 & 255, packed & 255
                keys.append(key_of(text, at, low, high))
                tids.append(tid)
                places.append(at)
            if len(keys) >= RUN_KEYS:
                yield from sorted_run(run)
                run += 1
                keys.clear(), tids.clear(), places.clear()
    if keys:
        yield from sorted_run(run)


RUN_ARROW = pa.schema([("first", pa.binary()), ("last", pa.binary()), ("id", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("classes", pa.list_(pa.int64())), ("tids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def _cut(splitters: list[bytes]):
    """Blocks dealt to key ranges; a block that a splitter cuts is coded anew in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for first, last, start, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = bisect_right(splitters, first), bisect_right(splitters, last)
                if a == b:
                    rows.append((a, start, data))
                    continue
                keys, shared, counts = map(list, zip(*((k, s, c) for s, k, c in front_decoded(data))))
                at = 0
                for r in range(a, b + 1):
                    end = bisect_left(keys, splitters[r], at) if r < b else len(keys)
                    if end > at:
                        rows.append((r, start + at, front_coded(keys[at:end], shared[at:end], counts[at:end])))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["range", "id", "data"])

    return run


class Stream:
    """The keys of one run within a range, with the prefix that each shares with the one before."""

    def __init__(self, blocks: list[tuple[int, bytes]]):
        self.blocks = blocks

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        """(shared, key, class id, count)"""
        previous = b""
        for start, data in self.blocks:
            for i, (shared, key, count) in enumerate(front_decoded(data)):
                yield (shared if i else common_prefix(previous, key)), key, start + i, count
                previous = key


class LoserTree:
    """Merges sorted streams of (shared, key, ...); yields their items in order, shared being the
    prefix that a key has in common with the key yielded before.

    Every waiting key knows the prefix that it shares with the last winner on its path. Of two such
    keys the one that shares more is smaller, without a look at its bytes; only if both share the same
    are bytes compared, from there on, and the loser keeps what it shares with the new winner.
    """

    def __init__(self, streams: list[Stream]):
        self.sources = [iter(s) for s in streams]
        self.size = 1 << max(0, (len(streams) - 1).bit_length())
        self.items: list[tuple | None] = [next(s, None) for s in self.sources] + [None] * (self.size - len(streams))
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        items, shared = self.items, self.shared
        if items[a] is None:
            return b, a
        if items[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = items[a][1], items[b][1]
        n = common_prefix(x, y, shared[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        items, shared, losers = self.items, self.shared, self.losers
        winner = self.winner
        while items[winner] is not None:
            item = items[winner]
            yield shared[winner], item[1], item[2], item[3]
            items[winner] = following = next(self.sources[winner], None)
            shared[winner] = following[0] if following else 0
            node = (winner + self.size) >> 1
            while node:
                winner, losers[node] = self._play(winner, losers[node])
                node >>= 1


class Class:
    """Equal contexts: their key, the class ids in runs, how many places, and the prefix shared with a neighbour in order."""

    __slots__ = ("key", "ids", "count", "near")

    def __init__(self, key: bytes, shared: int):
        self.key, self.ids, self.count, self.near = key, [], 0, shared


def groups(merged: Iterator[tuple[int, bytes, int, int]]) -> Iterator[list[Class]]:
    """Classes in order, those under one anchor string together."""
    group: list[Class] = []
    for shared, key, number, count in merged:
        if shared < GRAM and group:
            yield group
            group = []
        if not group or shared < len(key) or len(group[-1].key) != len(key):
            if group:
                group[-1].near = max(group[-1].near, shared)
            group.append(Class(key, shared if group else 0))
        group[-1].ids.append(number)
        group[-1].count += count
    if group:
        yield group


FOUND = "id long, low int, high int, w1 long, w2 long"


def _merge(splitters: list[bytes]):
    """A range's runs merged; rows: the strings (by low and high) of a class that are repeated, or the
    digest (w1, w2) of a string that has to be compared with other ranges' (id is null for a class
    that is repeated anyhow)."""
    cut_grams = {s[:GRAM] for s in splitters}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        by_run: dict[int, list[tuple[int, bytes]]] = {}
        for number, data in sorted(zip(table.column("id").to_pylist(), table.column("data").to_pylist())):
            by_run.setdefault(number >> PLACE_BITS, []).append((number, data))
        rows: list[tuple] = []
        for group in groups(iter(LoserTree([Stream(b) for b in by_run.values()]))):
            cut = group[0].key[:GRAM] in cut_grams
            for c in group:
                if c.count > 1:
                    rows += [(i, c.key[-2], c.key[-1], None, None) for i in c.ids]
            lone = any(c.count == 1 for c in group)
            if not lone and not cut or len(group) == 1 and not cut:
                continue
            away = cut or len(group) > GROUP_CLASSES
            seen: dict[bytes, int] = {}
            twice: dict[int, list[int]] = {}
            for k, c in enumerate(group):
                context, low, high = context_of(c.key)
                least = low if cut else max(low, LENGTH - c.near)
                for offset in range(least, high + 1):
                    digest = xxhash.xxh3_128_digest(context[high - offset : high - offset + LENGTH])
                    if away:
                        w1, w2 = np.frombuffer(digest, "<i8").tolist()
                        rows.append((c.ids[0] if c.count == 1 else None, offset, offset, w1, w2))
                    elif digest in seen:
                        twice.setdefault(k, []).append(offset)
                        twice.setdefault(seen[digest], []).append(offset)
                    else:
                        seen[digest] = k
            for k, offsets in twice.items():
                if group[k].count == 1:
                    rows.append((group[k].ids[0], min(offsets), max(offsets), None, None))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "low", "high", "w1", "w2"), columns, kinds)})

    return run


def spans_of(texts: DataFrame) -> DataFrame:
    """(tid, start, end): stretches of repeated bytes of distinct texts (tid, text), which may overlap."""
    spark = texts.sparkSession
    found = map_arrow(texts, _anchors, "tid long, anchor long, hash long")
    again = written(found.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash"), "repeated")
    kept = written(found.join(small(again), "hash", "left_semi").select("tid", "anchor"), "anchors")
    places = kept.groupBy("tid").agg(F.collect_list("anchor").alias("anchors"))
    runs, runs_path = written(map_arrow(texts.join(places, "tid").select("tid", "text", "anchors"), _runs, RUNS), "runs", with_path=True)
    blocks, keys = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = max(1, -(-keys // RANGE_KEYS))
    sample = runs.select("first", "id")
    if blocks > SAMPLE_KEYS:
        # by the block's number, so that of a hot key no more blocks are taken than of others
        sample = sample.where(F.pmod(F.xxhash64("id"), F.lit(-(-blocks // SAMPLE_KEYS))) == 0)
    firsts = sorted(sample.select("first").toArrow().column(0).to_pylist())
    splitters = sorted({firsts[len(firsts) * i // ranges] for i in range(1, ranges)} - {b""}) if len(firsts) > 1 else []
    dealt = map_arrow(runs.select("first", "last", "id", "data"), _cut(splitters), "range long, id long, data binary")
    judged = written(dealt.groupBy("range").applyInArrow(_merge(splitters), FOUND), "judged")
    settled = judged.where("w1 is null").select("id", "low", "high")
    alike = judged.where("w1 is not null").groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    more = judged.where("w1 is not null and id is not null").join(alike, ["w1", "w2"], "left_semi").select("id", "low", "high")
    verdicts = settled.unionByName(more.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    members = runs.select(F.explode(F.arrays_zip("classes", "tids", "places")).alias("m")).select(F.col("m.classes").alias("id"), F.col("m.tids").alias("tid"), F.col("m.places").alias("place"))
    out = members.join(verdicts, "id").select("tid", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("end"))
    out = written(out, "spans")
    discard(spark, runs_path)
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text, _spans (stretches of repeated bytes, array of start and end) and _whole (all of it is repeated) of every row.

    A null text counts as empty. A text under LENGTH bytes has no such bytes. Rows that repeat a text,
    under one id or several, repeat all of it.
    """
    return with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).toDF("doc_id", "text", "_spans", "_whole")


def with_spans(docs: DataFrame) -> DataFrame:
    """The columns of docs (with doc_id and text) as col0, col1, ..., so that no name clashes with those used here, then _spans and _whole."""
    columns = [f"col{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    key = F.col(columns[docs.columns.index("doc_id")]).cast("long")
    body = F.coalesce(F.col(columns[docs.columns.index("text")]), F.lit(""))
    marked = rows.withColumn("_digest", F.md5(body))
    narrow = written(marked.select(key.alias("doc_id"), "_digest", F.octet_length(body).alias("n")), "digests")
    odd = narrow.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count()
    tid: Column = F.xxhash64(key, "_digest") if odd else key
    narrow = narrow.withColumn("tid", F.xxhash64("doc_id", "_digest") if odd else F.col("doc_id")).where(F.col("n") >= LENGTH)
    copies = narrow.groupBy("_digest").agg(F.min("tid").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    whole = written(salted_join(narrow, copies, "_digest", "tid").where("rep is not null").select("tid", "rep"), "copies")
    texts = marked.where(F.octet_length(body) >= LENGTH).select(tid.alias("tid"), body.alias("text"))
    others = written(whole.where("tid <> rep").select("tid").distinct(), "others")
    spans = spans_of(texts.join(small(others), "tid", "left_anti"))
    by_text = spans.select("tid", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("s"), F.lit(False).alias("w"))
    by_text = by_text.unionByName(whole.select("tid", F.lit(None).cast("struct<start:int,end:int>").alias("s"), F.lit(True).alias("w")))
    by_text = by_text.groupBy("tid").agg(F.collect_list("s").alias("_spans"), F.max("w").alias("_whole"))
    return marked.withColumn("tid", tid).join(by_text, "tid", "left").select(*columns, "_spans", "_whole")


def maximal(spans: list[dict] | None, whole: bool | None, size: int) -> list[tuple[int, int]]:
    """Stretches that neither overlap nor touch, in order."""
    if whole and size >= LENGTH:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans without the bytes of characters that they only cover in part."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _stripped(at: int):
    """The last two columns are the spans; at is the text's place among the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, (spans, whole) = batch.columns[:-2], (c.to_pylist() for c in batch.columns[-2:])
            texts = []
            for value, text, s, w in zip(columns[at].is_null().to_pylist(), raw(columns[at]), spans, whole):
                found = whole_characters(text, maximal(s, w, len(text)))
                texts.append(None if value else without(text, found).decode("utf-8", "replace"))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, [f"col{i}" for i in range(len(columns))])

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, same rows and columns, without the repeated bytes of text; characters covered in part stay whole, a null text stays null."""
    schema = StructType([StructField(f"col{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    return map_arrow(with_spans(docs), _stripped(docs.columns.index("text")), schema).toDF(*docs.columns)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans, whole in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found = maximal(spans, whole, len(text))
            rows.append((len(text), sum(b - a for a, b in found), len(found), hashlib.sha256(without(text, found)).hexdigest()))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its bytes, those that repeated strings cover, their runs, and a digest of the rest.

    A null text is empty; texts under 200 bytes have nothing to remove, longer ones are read whole. Equal
    texts, and rows that repeat a document, remove all of each other; rows without an id are like others.
    Only doc_id and text are read, whatever other columns there are; an empty table gives an empty one.
    """
    return map_arrow(repeated(documents(spark, sf_dir)), _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP3_SQL = """
WITH b AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT k, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b WHERE length(h) >= 400),
w AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY x) AS c FROM w) WHERE c > 1),
g AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS s FROM r),
n AS (SELECT k, i, sum(s) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM g),
sp AS (SELECT k, g, min(i) AS a, max(i) + 200 AS e FROM n GROUP BY 1, 2),
ends AS (SELECT k, 0 AS a, coalesce(min(sp.a), any_value(length(b.h)) // 2) AS e FROM b LEFT JOIN sp USING (k) GROUP BY k
  UNION ALL SELECT sp.k, sp.e, coalesce(lead(sp.a) OVER (PARTITION BY sp.k ORDER BY sp.a), length(b.h) // 2) FROM sp JOIN b USING (k)),
kept AS (SELECT k, string_agg(substr(b.h, 2 * ends.a + 1, 2 * (ends.e - ends.a)), '' ORDER BY ends.a) AS t FROM ends JOIN b USING (k) GROUP BY 1),
cnt AS (SELECT k, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY 1)
SELECT b.doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.t)) AS kept_sha256
FROM b JOIN kept USING (k) LEFT JOIN cnt USING (k)
"""
