"""SentencePiece encoding in numpy batches, by merges or by a Viterbi search, and decoding.

A text is written with ▁ for spaces and one before it, and falls apart into units that no piece
crosses. Units of equal length advance together; hashes of substrings are sought among the sorted
hashes of the pieces. A character without a piece is written as its UTF-8 bytes.

A BPE model's scores are ranks: each pass merges in every unit the adjacent pair whose piece ranks
best, of equal ones the leftmost, until no pair makes a piece. A unigram model's scores are log
probabilities: at each end position a vectorised maximum keeps the best sum and its backpointer; an
unknown character costs less than any piece, and of equal sums the one whose last piece is longest wins.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow
from .shingles import STEP

SPACE = "▁"
#: Units of more characters are searched one by one, over all their substrings at once.
LONG_UNIT = 48
#: Units kept in a worker with their ids; at this number the memory starts anew.
CACHE_UNITS = 1_500_000
#: Units of one length that advance together.
EQUAL_UNITS = 4_000
#: Bits of a hash by which substrings that are no piece are told apart without a search; a byte for each value.
SIEVE_BITS = 20
#: Ends of a long unit whose substrings are held at once.
BLOCK = 1 << 14
#: What an unknown character's score lies below the lowest piece's.
UNKNOWN_PENALTY = 10.0
BASE = np.uint64(0x100000001B3)
#: A byte that no UTF-8 has, between units decoded at once.
END = b"\xff"
UNIT = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class PieceModel:
    """Pieces of a SentencePiece model file: scores, sorted hashes, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = {i: sp.id_to_piece(i) for i in normal}
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t in texts.values()):
            raise ValueError("pieces cross the units of this operator")
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        self.longest = max(map(len, texts.values()))
        keys = np.array([self.raw_key(t) for t in texts.values()], np.uint64) * STEP
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(texts), np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        slots = (self.keys >> np.uint64(64 - SIEVE_BITS)).view(np.int64)
        in_slot = np.bincount(slots, minlength=1 << SIEVE_BITS)
        self.sieve, self.most = in_slot > 0, int(in_slot.max())
        self.begins = (np.cumsum(in_slot) - in_slot).astype(np.int32)
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids], np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.powers = np.ones(self.longest + 1, np.uint64)
        for k in range(1, len(self.powers)):
            self.powers[k : k + 1] = self.powers[k - 1 : k] * BASE
        self.out = [b""] * size
        for i, t in texts.items():
            self.out[i] = t.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])

    @staticmethod
    def prefix_hashes(codes: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of each row of code points."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k]
        return out

    @classmethod
    def raw_key(cls, text: str) -> np.uint64:
        codes = np.array([[ord(c) + 1 for c in text]], np.uint64)
        return (cls.prefix_hashes(codes)[:, -1] + np.uint64(len(text)))[0]

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these unmixed hashes are pieces, and the places of those among the sorted keys.

        The upper bits of a key give where its like begin; most that are no piece have none there.
        """
        keys = raw * STEP
        slots = (keys >> np.uint64(64 - SIEVE_BITS)).view(np.int64)
        maybe = np.flatnonzero(self.sieve.take(slots))
        keys, at = keys[maybe], self.begins[slots[maybe]]
        same = self.keys[at] == keys
        for _ in range(self.most - 1):
            at = np.where(same, at, np.minimum(at + 1, len(self.keys) - 1))
            same = self.keys[at] == keys
        return maybe[same], at[same]

    def probe(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the pieces with these unmixed hashes (minus infinity: none) and their places."""
        hits, places = self.find(raw)
        score, at = np.full(len(raw), -np.inf), np.zeros(len(raw), np.int64)
        score[hits], at[hits] = self.scores[places], places
        return score, at

    def encode_equal(self, units: list[str]) -> list[bytes]:
        """Ids of units of one length, all advancing together (little-endian, 32 bits each)."""
        n, length = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64) + np.uint64(1)
        # a row for each end, so that what is read and written together lies together
        prefix = np.ascontiguousarray(self.prefix_hashes(codes).T)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        columns = np.arange(n)
        for end in range(1, length + 1):
            low = max(0, end - self.longest)
            widths = np.arange(end - low, 0, -1)
            hits, at = self.find((prefix[end] - prefix[low:end] * self.powers[widths, None] + widths[:, None].astype(np.uint64)).ravel())
            total, place = np.full((end - low, n), -np.inf), np.full((end - low) * n, -1, np.int32)
            total[-1] = best[end - 1] + self.unknown
            total.ravel()[hits] = best[low:end].ravel()[hits] + self.scores[at]
            place[hits] = at
            # the first of equal sums has the longest last piece
            chosen = total.argmax(axis=0)
            best[end], back[end], piece[end] = total[chosen, columns], low + chosen, place[chosen * n + columns]
        return self._trace_equal(units, back.T, piece.T)

    def _trace_equal(self, units: list[str], back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Follows the backpointers of all units at once, from the end; units with unknown characters go one by one."""
        n, length = len(units), len(units[0])
        rows, end = np.arange(n), np.full(n, length)
        steps: list[np.ndarray] = []
        unknown = np.zeros(n, bool)
        while end.any():
            last = np.where(end > 0, piece[rows, end], -2)
            unknown |= last == -1
            steps.append(last)
            end = np.where(end > 0, back[rows, end], 0)
        grid = np.stack(steps[::-1], axis=1)
        taken = grid != -2
        data = self.ids[grid[taken]].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(taken.sum(axis=1))])).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(unknown).tolist():
            out[k] = self._trace(units[k], back[k].tolist(), piece[k].tolist())
        return out

    def encode_long(self, unit: str) -> bytes:
        """Ids of one unit: in blocks of ends, substrings of all lengths are probed at once, then scores are carried on."""
        length = len(unit)
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        best, back, piece = array("d", [0.0]) + array("d", [-np.inf]) * length, array("i", [0]) * (length + 1), array("i", [-1]) * (length + 1)
        for low in range(0, length, BLOCK):
            high, first = min(low + BLOCK, length), max(0, low - self.longest + 1)
            ends: list[list[tuple[int, float, int]]] = [[] for _ in range(high - low)]
            part = codes[first:high]
            window = np.zeros(len(part), np.uint64)
            for width in range(1, min(self.longest, len(part)) + 1):
                window = window[: len(part) - width + 1] * BASE + part[width - 1 :]
                hits, at = self.find(window + np.uint64(width))
                fresh = hits + first + width > low
                hits, at = hits[fresh], at[fresh]
                for s, v, p in zip((hits + first).tolist(), self.scores[at].tolist(), at.tolist()):
                    ends[s + width - low - 1].append((s, v, p))
            for end, options in enumerate(ends, low + 1):
                if not options or options[0][0] != end - 1:
                    options.insert(0, (end - 1, self.unknown, -1))
                # the shortest was found first; the longest is to win among equals
                for start, value, p in reversed(options):
                    if best[start] + value > best[end]:
                        best[end], back[end], piece[end] = best[start] + value, start, p
        return self._trace(unit, back, piece)

    def _trace(self, unit: str, back: Sequence[int], piece: Sequence[int]) -> bytes:
        end, ids = len(unit), array("I")
        while end:
            start = back[end]
            ids.extend([int(self.ids[piece[end]])] if piece[end] >= 0 else [self.bytes[b] for b in reversed(unit[start:end].encode("utf-8", "surrogatepass"))])
            end = start
        return np.array(ids[::-1], "<u4").tobytes()

    def with_scores(self, log_probabilities: np.ndarray) -> PieceModel:
        """A unigram model of the same pieces with these scores, by id."""
        out = object.__new__(PieceModel)
        out.__dict__.update(self.__dict__)
        out.scores = log_probabilities[self.ids]
        out.unknown = float(out.scores.min()) - UNKNOWN_PENALTY
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, ▁ as space, without the space before the text."""
        data = b"".join(map(self.out.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


class MergeModel(PieceModel):
    """Pieces of a BPE model: units are encoded by merging adjacent symbols, the best-ranked pair first."""

    def __init__(self, path: str):
        super().__init__(path)
        if {x.type for x in _proto(path).pieces} & {4, 5}:
            raise ValueError("user-defined or unused pieces are not merged by rank alone")
        texts = (self.out[i].decode().replace(" ", SPACE) for i in self.ids.tolist())
        self.ranked = dict(zip(texts, zip(self.scores.tolist(), self.ids.tolist())))

    def _between(self, prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """probe() of the substrings [start, end) of rows."""
        width = end - start
        score, at = self.probe(prefix[rows, end] - prefix[rows, start] * self.powers[np.minimum(width, self.longest)] + width.astype(np.uint64))
        return np.where(width > self.longest, -np.inf, score), at

    def encode_equal(self, units: list[str]) -> list[bytes]:
        """Ids of units of one length; each pass merges one pair in every unit that still has one."""
        n, length = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64) + np.uint64(1)
        prefix = self.prefix_hashes(codes)
        after = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        begins = np.ones((n, length), bool)
        #: The score of the pair whose left symbol begins here.
        pair = np.full((n, length), -np.inf)
        if length > 1:
            pair[:, :-1] = self.probe((prefix[:, 2:] - prefix[:, :-2] * self.powers[2] + np.uint64(2)).ravel())[0].reshape(n, -1) if self.longest > 1 else -np.inf
        rows = np.arange(n)
        while len(rows):
            left = pair[rows].argmax(axis=1)
            some = pair[rows, left] > -np.inf
            rows, left = rows[some], left[some]
            middle = after[rows, left]
            end = after[rows, middle]
            after[rows, left], before[rows, end] = end, left
            begins[rows, middle], pair[rows, middle] = False, -np.inf
            more = end < length
            pair[rows, left] = -np.inf
            pair[rows[more], left[more]] = self._between(prefix, rows[more], left[more], after[rows[more], end[more]])[0]
            first = before[rows, left]
            more = first >= 0
            pair[rows[more], first[more]] = self._between(prefix, rows[more], first[more], end[more])[0]
        row, start = np.nonzero(begins)
        score, at = self._between(prefix, row, start, after[row, start])
        data = self.ids[at].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(begins.sum(axis=1))])).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(row[score == -np.inf]).tolist():
            out[k] = self._symbols(units[k], np.flatnonzero(begins[k]).tolist())
        return out

    def encode_long(self, unit: str) -> bytes:
        """Ids of one unit, with the pairs in a heap."""
        length, ranked = len(unit), self.ranked
        after, before, begins = list(range(1, length + 1)), list(range(-1, length)), bytearray(b"\1" * length)
        heap: list[tuple[float, int, int]] = []

        def meet(start: int, end: int) -> None:
            if end - start <= self.longest and (found := ranked.get(unit[start:end])):
                heapq.heappush(heap, (-found[0], start, end))

        for start in range(length - 1):
            meet(start, start + 2)
        while heap:
            _, left, end = heapq.heappop(heap)
            if not begins[left] or (middle := after[left]) == length or after[middle] != end:
                continue
            after[left], before[end], begins[middle] = end, left, 0
            if end < length:
                meet(left, after[end])
            if before[left] >= 0:
                meet(before[left], end)
        return self._symbols(unit, [k for k in range(length) if begins[k]])

    def _symbols(self, unit: str, starts: list[int]) -> bytes:
        """Ids of a unit's symbols; those without a piece as bytes."""
        ids: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(unit)]):
            found = self.ranked.get(unit[a:b])
            ids += [found[1]] if found else [self.bytes[x] for x in unit[a:b].encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read())


def model_of(path: str) -> PieceModel:
    """The model in a file, encoding as its kind does: BPE by merges, unigram by the best sum."""
    kind = _proto(path).trainer_spec.model_type
    if kind not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    return MergeModel(path) if kind == 2 else PieceModel(path)


class Units:
    """Numbers of the units seen, from 0 in the order they came; a worker's encoders share them."""

    def __init__(self):
        self.age = -1
        self._begin()

    def _begin(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.names: list[str] = []
        self.age += 1

    def numbers(self, split: list[list[str]]) -> np.ndarray:
        """The numbers of all units of these lists, one after the other. They hold until the next call, which may start anew."""
        if len(self.names) > CACHE_UNITS:
            self._begin()
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        newest = list(islice(reversed(self.known), len(self.known) - len(self.names)))
        self.names += reversed(newest)
        return out


class Encoder:
    """Ids of texts, with the ids of units remembered from batch to batch; a plain Viterbi search if no model is given.

    The ids of all units lie in one array, and a batch's are taken from it by the numbers of its units at once.
    """

    def __init__(self, path: str, model: PieceModel | None = None, seen: Units | None = None):
        self.model = model or PieceModel(path)
        self.seen = Units() if seen is None else seen
        self._begin()

    def _begin(self) -> None:
        self.age, self.used, self.flat = self.seen.age, 0, np.zeros(1 << 16, np.uint32)
        #: Where a unit's ids begin (-1: not known yet) and how many they are; whether they decode to the unit, where that was asked.
        self.begins, self.sizes, self.exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)

    def units(self, text: str) -> list[str]:
        """Units of a text; an empty text has none."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text or f"{SPACE}\n" in text or "\0" in text:
            return UNIT.findall(text)
        return text.replace("\n", "\0\n\0").replace(SPACE, "\0" + SPACE)[1:].replace("\0\0", "\0").removesuffix("\0").split("\0")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, 32 bits each."""
        split = [self.units(x) for x in texts]
        return [x.tobytes() for x in self.parted(self.seen.numbers(split), split)]

    def parted(self, numbers: np.ndarray, split: list[list[str]]) -> list[np.ndarray]:
        """The ids (unsigned, 32 bits) of each list of units, whose numbers follow each other in numbers."""
        self._learn(numbers)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begins[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, numbers: np.ndarray) -> None:
        """Encodes the units with these numbers that have no ids yet."""
        if self.age != self.seen.age:
            self._begin()
        names = self.seen.names
        if (more := len(names) - len(self.begins)) > 0:
            self.begins = np.concatenate([self.begins, np.full(more, -1, np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int64)])
            self.exact = np.concatenate([self.exact, np.full(more, -1, np.int8)])
        fresh = np.zeros(len(names), bool)
        fresh[numbers] = True
        fresh &= self.begins < 0
        places = np.flatnonzero(fresh)
        lengths = np.fromiter((len(names[k]) for k in places.tolist()), np.int64, len(places))
        order = np.argsort(lengths, kind="stable")
        for alike in np.split(places[order], np.flatnonzero(np.diff(lengths[order])) + 1):
            for i in range(0, len(alike), EQUAL_UNITS):
                part = alike[i : i + EQUAL_UNITS]
                units = [names[k] for k in part.tolist()]
                self._keep(part, [self.model.encode_long(u) for u in units] if len(units[0]) > LONG_UNIT else self.model.encode_equal(units))

    def _keep(self, places: np.ndarray, encoded: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(encoded), "<u4")
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) >> 2
        if (need := self.used + len(ids)) > len(self.flat):
            wider = np.zeros(max(need, 2 * len(self.flat)), np.uint32)
            wider[: self.used] = self.flat[: self.used]
            self.flat = wider
        self.flat[self.used : need] = ids
        self.begins[places], self.sizes[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = need

    def exactly(self, numbers: np.ndarray) -> np.ndarray:
        """Whether the ids of each of these units, which parted() has been given, decode to the unit; a unit is decoded once."""
        asked = np.zeros(len(self.exact), bool)
        asked[numbers] = True
        out, names = [*self.model.out, END], self.seen.names
        places = np.flatnonzero(asked & (self.exact < 0))
        sizes = self.sizes[places]
        ids = self.flat[np.repeat(self.begins[places] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        data = b"".join(map(out.__getitem__, np.insert(ids, np.cumsum(sizes), len(out) - 1).tolist()))
        self.exact[places] = [x == names[k].replace(SPACE, " ").encode("utf-8", "surrogatepass") for x, k in zip(data.split(END), places.tolist())]
        return self.exact[numbers] > 0

    def round_trips(self, texts: list[str], ids: list[np.ndarray], numbers: np.ndarray, split: list[list[str]]) -> list[bool]:
        """Whether decoding gives each text back. Decoding joins what the units decode to, so a text of units that come back does as well;
        others, and those with ▁, which comes back as a space, are decoded as a whole."""
        wrong = np.concatenate([[0], np.cumsum(~self.exactly(numbers))])[np.cumsum([0, *map(len, split)])]
        well = (np.diff(wrong) == 0).tolist()
        return [SPACE not in t if good else self.model.decode(x.tolist()) == t for good, t, x in zip(well, texts, ids)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that units stay known from task to task."""
    return Encoder(path, model_of(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = encoder.encode_batch(pc.fill_null(batch.column(1), "").to_pylist())
            values = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(path).model
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encoded(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null or empty text has no ids."""
    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), _encode(model_path), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; bytes that are no UTF-8 become replacement characters."""
    return map_arrow(tokens.select("doc_id", "ids"), _decode(model_path), "doc_id long, text string")


@lru_cache(maxsize=1)
def searcher_of(path: str, scores: bytes) -> Encoder:
    """One encoder by a Viterbi search over these scores (64-bit floats by id) for all tasks of a worker; it shares the numbers of units."""
    encoder = encoder_of(path)
    return Encoder(path, encoder.model.with_scores(np.frombuffer(scores, np.float64)), encoder.seen)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        counts = np.zeros(len(encoder.model.out), np.int64)
        for batch in batches:
            units = [encoder.units(x) for x in pc.fill_null(batch.column(0), "").to_pylist()]
            ids = encoder.parted(encoder.seen.numbers(units), units)
            counts += np.bincount(np.concatenate(ids), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "n"])

    return run


def piece_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """piece (its id) and n, how often it comes in the encodings of all rows; a task hands on one row a piece."""
    return map_arrow(docs.select(F.col(text).alias("text")), _count(model_path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame, model_path: str) -> np.ndarray:
    """Natural logarithms of (n + 1) / (N + V) by id, of counts as piece_counts() has them: as many numbers as the model has pieces."""
    values = np.ones(len(encoder_of(model_path).model.out))
    for piece, n in counts.select("piece", "n").collect():
        values[piece] += n
    return np.log(values) - np.log(values.sum())


def _searched(path: str, scores: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, table = searcher_of(path, scores), np.frombuffer(scores, np.float64)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in searcher.encode_batch(pc.fill_null(batch.column(1), "").to_pylist())]
            sums = pa.array([float(table[x].sum()) for x in ids], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), sums], ["doc_id", "ids", "log_prob"])

    return run


def searched(docs: DataFrame, model_path: str, scores: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and log_prob of every row: the segmentation into the model's pieces whose scores (log probabilities by id) have
    the greatest sum, found by a Viterbi search. Characters without a piece are bytes. A null or empty text has no ids and 0."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _searched(model_path, scores.astype(np.float64).tobytes()), "doc_id long, ids array<int>, log_prob double")


DIGEST = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, log_prob double, n_best_pieces long, best_crc32 long, best_log_prob double"


def _digest(path: str, scores: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, searcher, table = encoder_of(path), searcher_of(path, scores), np.frombuffer(scores, np.float64)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            split = [encoder.units(x) for x in texts]
            numbers = searcher.seen.numbers(split)
            merged, best = encoder.parted(numbers, split), searcher.parted(numbers, split)
            columns = [
                pa.array([len(x) for x in merged], pa.int64()),
                pa.array([zlib.crc32(x) for x in merged], pa.int64()),
                pa.array(encoder.round_trips(texts, merged, numbers, split), pa.bool_()),
                pa.array([float(table[x].sum()) for x in merged], pa.float64()),
                pa.array([len(x) for x in best], pa.int64()),
                pa.array([zlib.crc32(x) for x in best], pa.int64()),
                pa.array([float(table[x].sum()) for x in best], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in DIGEST.split(", ")])

    return run


def production_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: the number of pieces, the CRC-32 of its ids (little-endian, 32 bits each), and whether decoding gives the
    text back; and the same number and CRC-32 of the segmentation that is likeliest by the pieces' frequencies in all documents,
    which a Viterbi search finds, with the log probabilities of both.

    A null or empty text has no pieces; long texts are encoded whole, by their units. Equal texts have equal
    ids, and rows that share an id, or have none, each have their row. Only doc_id and text are read; an
    empty table gives an empty one.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = production_model()
    scores = log_probabilities(piece_counts(docs, path), path)
    return map_arrow(docs, _digest(path, scores.tobytes()), DIGEST)
