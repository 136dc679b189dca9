"""N-gram language model as a weighted backoff automaton, trained and applied in blocks.

A state is an n-gram shorter than the order that was seen in training; its arcs are the words seen
after it, its failure arc leads to the state without the n-gram's first word. Probabilities are
smoothed by interpolation with a Dirichlet prior: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m),
down to the add-one unigram P(w) = (c(w) + 1) / (N + V + 1). An arc weighs log10 P(w | h); a word
without an arc costs the failure arc's log10 m / (c(h) + m) and is read in the shorter state. Every
state's probabilities sum to one. A text is read from the left in one pass, in which the state is
carried from word to word and the weights add up.

Counts are global, scoring is local. Texts are packed into blocks as they come, each word as its
number in the block's own vocabulary, in one written table: from there on no text is read again. A
block sends its distinct n-grams, as sorted 64-bit keys for each shard of the key space; a shard
adds up the counts of all blocks and answers each block for the keys that it sent. A block thus
compiles the part of the automaton that its texts can reach, and no task ever holds the model
whole. A key is at most once in a block's message, so no n-gram is hot however frequent it is.
Keys are hashes of KEY_BITS bits: of n keys, about n * n / 2**(KEY_BITS + 1) pairs have one in common
and add up their counts (0.07 pairs of 10**8 n-grams, one n-gram in 7,000 of 2 * 10**13).

Long texts are cut into segments that are read side by side: from the empty state, order - 1 words
lead to the same state as the whole text before them, as a state is the longest known n-gram that
ends there; so a segment starts that many words early.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, written
from .shingles import STEP, distinct, mix, word_hashes

ORDER = 3
#: The prior's weight m, in counts.
PRIOR = 100.0
#: Text of a block, and n-gram keys of a shard, in a task's memory.
BLOCK_BYTES = 6_000_000
SHARD_KEYS = 2_000_000
#: Words of a text that are read one after the other, side by side with other segments.
SEGMENT = 256
#: Bits of a key; each eight more cost a seventh of what is shuffled.
KEY_BITS = 56
SPARE = np.uint64(64 - KEY_BITS)
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)


def held_out(key: Column) -> Column:
    """Documents that the model does not learn from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


BLOCKS = "block long, doc_ids array<long>, learn binary, sizes binary, vocabulary binary, words binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("learn", "sizes", "vocabulary", "words")]])


def planes_packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte apart and compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def planes_unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, : data[0]] = planes.T
    return full.reshape(-1).view("<i8")


def _pack(limit: int):
    """Blocks of whole texts: distinct hashes of words, and for each text its words by number, then the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        first = (task.partitionId() if task else 0) << 30
        ids, learn, sizes, parts, held = [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            vocabulary, words = np.unique(np.concatenate(parts), return_inverse=True)
            row = (first + number, ids, np.array(learn, np.uint8).tobytes(), planes_packed(np.array(sizes)), delta_packed(vocabulary), planes_packed(words))
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, row))], schema=BLOCK_SCHEMA)

        for batch in batches:
            for at in cuts(batch.column(1), limit):
                part = batch.slice(at.start, at.stop - at.start)
                hashes, counts = word_hashes(part.column(1))
                parts.append(np.insert(hashes >> SPARE, np.cumsum(counts), END))
                ids += part.column(0).to_pylist()
                learn += part.column(2).to_pylist()
                sizes += (counts + 1).tolist()
                held += part.column(1).nbytes
                if held >= limit:
                    yield packed()
                    ids, learn, sizes, parts, held, number = [], [], [], [], 0, number + 1
        if ids:
            yield packed()

    return run


def cuts(texts: pa.Array, limit: int) -> Iterator[slice]:
    """Runs of texts of at most limit bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield slice(at, stop)
        at = stop


class Block:
    """A block's words, one text after the other, each text with its end."""

    def __init__(self, row: dict, order: int):
        self.doc_ids = row["doc_ids"]
        self.learn = np.frombuffer(row["learn"], np.uint8).astype(bool)
        self.sizes = planes_unpacked(row["sizes"])
        self.vocabulary = delta_unpacked(row["vocabulary"])
        self.words = planes_unpacked(row["words"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.order = order

    def keys(self) -> Iterator[np.ndarray]:
        """Keys of the n-grams that end at each word, for n = 2..order."""
        hashes = self.vocabulary[self.words]
        before = hashes
        for n in range(2, self.order + 1):
            earlier = np.empty_like(before)
            earlier[n - 1 :] = hashes[: len(hashes) - n + 1]
            for k in range(min(n - 1, len(hashes))):
                at = self.starts[self.sizes > k] + k
                earlier[at] = START
            before = extended(before, earlier, n)
            yield before


def extended(gram: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    """The key of an n-gram from that of its last n - 1 words and its first word."""
    return mix(gram * STEP + mix(earlier + np.uint64(n))) >> SPARE


def start_keys(order: int) -> np.ndarray:
    """The keys of the histories of 1..order - 1 starts."""
    out, key = [], np.array([START], np.uint64)
    for n in range(1, order):
        key = key if n == 1 else extended(key, np.array([START], np.uint64), n)
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes where learn holds."""
    every = distinct(keys)
    known, counts = np.unique(keys[learn], return_counts=True)
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, known)] = counts
    return every, out


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards that sorted keys touch, and where. Shards are ranges of the key space, so sorted keys are sorted by shard too."""
    shard = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, slice(int(cuts[s]), int(cuts[s + 1]))


def delta_packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as many byte planes as the largest needs; the two highest planes are compressed."""
    steps = np.diff(keys)
    width = max(2, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + len(steps).to_bytes(8, "little") + planes[: width - 2].tobytes() + zlib.compress(planes[width - 2 :].tobytes(), 1)


def delta_unpacked(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    n = int.from_bytes(data[9:17], "little")
    plain = 17 + n * (width - 2)
    planes = np.frombuffer(data[17:plain] + zlib.decompress(data[plain:]), np.uint8).reshape(width, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, full.reshape(-1).view("<u8")]), dtype=np.uint64)


def counts_unpacked(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], "<i8")
    return out


def counts_packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 1)


MESSAGE = "block long, shard long, keys binary, counts binary"
#: Shards of longer n-grams have numbers from here on; those of words are below.
LONGER = 1 << 40


def _send(order: int, word_shards: int, shards: int):
    """A block's messages: its distinct words and histories of starts, then its distinct longer n-grams, with their counts."""

    def messages(row: dict) -> Iterator[tuple[int, bytes, bytes]]:
        block = Block(row, order)
        weight = np.repeat(block.learn, block.sizes)
        starts = start_keys(order)
        texts = np.full(len(starts), int(block.learn.sum()), np.int64)
        yield from packed(block.vocabulary, np.bincount(block.words[weight], minlength=len(block.vocabulary)), word_shards, 0)
        grams = [counted(keys, weight) for keys in block.keys()]
        keys, counts = np.concatenate([*[g[0] for g in grams], starts]), np.concatenate([*[g[1] for g in grams], texts])
        at = np.argsort(keys)
        yield from packed(keys[at], counts[at], shards, LONGER)

    def packed(keys: np.ndarray, counts: np.ndarray, shards: int, first: int) -> Iterator[tuple[int, bytes, bytes]]:
        for s, part in by_shard(keys, shards):
            yield first + s, delta_packed(keys[part]), counts_packed(counts[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(messages(row))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["block", "shard", "keys", "counts"])

    return run


ANSWER = "block long, shard long, counts binary, tokens long, types long"


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's messages, with the sum over all blocks in place of each block's counts. The first
    row of a shard of words also holds the shard's tokens and types."""
    keys = [delta_unpacked(x) for x in table.column("keys").to_pylist()]
    counts = [counts_unpacked(x, len(k)) for x, k in zip(table.column("counts").to_pylist(), keys)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [counts_packed(x) for x in np.split(totals[inverse], ends[:-1])]
    is_words, rest = key[0].as_py() < LONGER, [0] * (len(answers) - 1)
    tokens, types = (int(totals.sum()), int((totals > 0).sum())) if is_words else (0, 0)
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "counts": pa.array(answers, pa.binary()), "tokens": pa.array([tokens, *rest], pa.int64()), "types": pa.array([types, *rest], pa.int64())})


class Transitions:
    """Arcs by state and word, in a table of open addresses that is filled and probed in arrays."""

    def __init__(self, state: np.ndarray, word: np.ndarray, words: int):
        self.words = np.int64(words)
        self.pairs = state * self.words + word
        self.bits = max(4, int(2 * len(self.pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(self.pairs), dtype=np.int32)
        at = self.address(self.pairs)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def address(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * STEP >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state and word, or -1."""
        pairs = state * self.words + word
        at = self.address(pairs)
        out = self.slots[at]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self.pairs[out[open_]] != pairs[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            out[open_] = found
            more = np.flatnonzero(found >= 0)
            open_ = open_[more[self.pairs[found[more]] != pairs[open_[more]]]]
        return out


class Automaton:
    """The part of the model that a block can reach.

    State 0 is the empty history, whose arcs are word_weight and word_next by a word's number; the
    other states have the arcs of transitions, with weight and next, and a failure arc each.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], starts: np.ndarray, keys: list[np.ndarray], total: int, types: int, prior: float):
        order = block.order
        word_counts = counts[0]
        p = (word_counts + 1) / (total + types + 1)
        self.word_weight = np.log10(p)
        # states by order of their n-gram: words first, then longer n-grams, then the histories of starts
        seen = [c > 0 for c in counts]
        number, used = [], 1
        for n in range(1, order):
            ids = np.zeros(len(counts[n - 1]), np.int64)
            k = int(seen[n - 1].sum())
            ids[seen[n - 1]] = np.arange(used, used + k)
            number.append(ids)
            used += k
        starting = np.where(starts > 0, np.arange(used, used + len(starts)), 0)
        used += len(starts)
        size = np.zeros(used, np.int64)
        for ids, c in zip(number, counts):
            size[ids] = c
        size[starting] = starts
        size[0] = 0
        self.failure = np.zeros(used, np.int64)
        self.failure_weight = np.log10(prior / (size + prior))
        self.word_next = number[0] if order > 1 else np.zeros(len(word_counts), np.int64)
        for k in range(1, len(starting)):
            self.failure[starting[k]] = starting[k - 1]
        self.start = int(starting[starts > 0][-1]) if (starts > 0).any() else 0
        # arcs of n-grams from two words on: from the history's state, by the last word
        shorter, arc_state, arc_word, arc_weight, arc_next = None, [], [], [], []
        first = np.zeros(len(block.words), bool)
        first[block.starts] = True
        for n in range(2, order + 1):
            every = keys[n - 2]
            distinct_keys, at = np.unique(every, return_index=True)
            suffix = block.words[at] if n == 2 else np.searchsorted(shorter, keys[n - 3][at])
            history = np.zeros(len(at), np.int64)
            inner = ~first[at]
            before = at[inner] - 1
            history[inner] = number[n - 2][block.words[before] if n == 2 else np.searchsorted(shorter, keys[n - 3][before])]
            history[~inner] = starting[n - 2]
            p = (counts[n - 1] + prior * p[suffix]) / (size[history] + prior)
            real = seen[n - 1]
            arc_state.append(history[real])
            arc_word.append(block.words[at[real]])
            arc_weight.append(np.log10(p[real]))
            if n < order:
                self.failure[number[n - 1][real]] = number[n - 2][suffix[real]]
                arc_next.append(number[n - 1][real])
            else:
                arc_next.append(number[n - 2][suffix[real]])
            shorter = distinct_keys
        none = [np.zeros(0, np.int64)]
        self.transitions = Transitions(np.concatenate(arc_state or none), np.concatenate(arc_word or none), len(word_counts))
        self.weight, self.next = np.concatenate(arc_weight or [np.zeros(0)]), np.concatenate(arc_next or none)

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of reading a word in each state, and the state that it leads to."""
        cost, state, after = np.zeros(len(word)), state.copy(), np.zeros(len(word), np.int64)
        left = np.arange(len(word))
        while len(left):
            here, w = state[left], word[left]
            empty = here == 0
            done = left[empty]
            cost[done] += self.word_weight[w[empty]]
            after[done] = self.word_next[w[empty]]
            left, here, w = left[~empty], here[~empty], w[~empty]
            arc = self.transitions.of(here, w)
            found = arc >= 0
            done = left[found]
            cost[done] += self.weight[arc[found]]
            after[done] = self.next[arc[found]]
            left, here = left[~found], here[~found]
            cost[left] += self.failure_weight[here]
            state[left] = self.failure[here]
        return cost, after

    def walk(self, block: Block, segment: int) -> np.ndarray:
        """The log10 probability of each text of a block."""
        cuts = -(-block.sizes // segment)
        text = np.repeat(np.arange(len(cuts)), cuts)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * segment
        early = np.minimum(inside, block.order - 1)
        length = np.minimum(block.sizes[text] - inside, segment) + early
        begin = block.starts[text] + inside - early
        state = np.where(inside == early, self.start, 0)
        by_length = np.argsort(-length, kind="stable")
        early, length, begin, state = early[by_length], length[by_length], begin[by_length], state[by_length]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
        costs = np.zeros(len(block.words))
        for step, lanes in enumerate(active):
            cost, state[:lanes] = self.read(state[:lanes], block.words[begin[:lanes] + step])
            counted = early[:lanes] <= step
            costs[begin[:lanes][counted] + step] = cost[counted]
        return np.add.reduceat(costs, block.starts)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, word_shards: int, shards: int, prior: float, total: int, types: int, segment: int):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist()))
        block = Block(blocks.to_pylist()[0], order)

        def counts_of(sorted_keys: np.ndarray, shards: int, first: int) -> np.ndarray:
            return np.concatenate([counts_unpacked(found[first + s], at.stop - at.start) for s, at in by_shard(sorted_keys, shards)])

        counts = [counts_of(block.vocabulary, word_shards, 0)]
        keys, starts = list(block.keys()), np.zeros(order - 1, np.int64)
        if order > 1:
            grams = [distinct(k) for k in keys]
            flat = np.concatenate([*grams, start_keys(order)])
            at = np.argsort(flat)
            longer = np.empty(len(flat), np.int64)
            longer[at] = counts_of(flat[at], shards, LONGER)
            *parts, starts = np.split(longer, np.cumsum([len(g) for g in grams]))
            counts += parts
        automaton = Automaton(block, counts, starts, keys, total, types, prior)
        add = lambda x: np.add.reduceat(x, block.starts)
        n = len(block.sizes)
        return pa.table(
            {
                "doc_id": pa.array(block.doc_ids, pa.int64()),
                "held_out": pa.array(~block.learn),
                "n_tokens": pa.array(block.sizes),
                "n_known": pa.array(add((counts[0] > 0)[block.words].astype(np.int64))),
                "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(add(automaton.word_weight[block.words])),
                "score": pa.array(automaton.walk(block, segment)),
            }
        )

    return run


def scored(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its log10 probabilities; null and empty texts are their end token alone.

    Rows that repeat a document count as often as they come. Without any row to learn from, N and V
    are 0 and every token has probability 1. A text longer than a block is a block of its own.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~held_out(F.col(key))).alias("learn"))
    blocks = written(map_arrow(rows, _pack(BLOCK_BYTES), BLOCKS), "blocks")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0))
    # a word of a vocabulary takes about six bytes, a word of a text two
    vocabularies, words = blocks.agg(size("vocabulary"), size("words")).first()
    word_shards, shards = max(1, -(-vocabularies // 6 // SHARD_KEYS)), max(1, -(-words // 2 * (order - 1) // SHARD_KEYS))
    sent = blocks.mapInArrow(_send(order, word_shards, shards), MESSAGE)
    answered = written(sent.groupBy("shard").applyInArrow(_answer, ANSWER), "counts")
    total, types = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    answered = answered.select("block", "shard", "counts")
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(order, word_shards, shards, prior, total, types, SEGMENT), SCORED)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() on every document; nulls, empty and repeated texts and empty tables as there."""
    return scored(documents(spark, sf_dir))
