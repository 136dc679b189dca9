"""Best-fit packing of token documents into fixed-length sequences, with certified bin counts.

Documents are cut only if they are longer than a sequence. Pieces are dealt to partitions by a hash
and packed best-fit decreasing; a dual-feasible-function bound tells how few sequences a partition
could need. Partitions above their bound release their least filled sequences; these meet in new
partitions, whole, and are packed again, and a regrouping is kept only if it saves a sequence.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, written

CAPACITY = 1024
END_ID = 2
#: Pieces in one packing task.
PIECES_PER_TASK = 50_000
#: Times that partitions with gaps exchange sequences.
EXCHANGES = 3
#: How the byte-level BPE parts a text before it merges (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of texts by a byte-level BPE of a tokenizers file.

    Where the file's vocabulary in order is also its merge order, the faster of the two public BPE
    libraries encodes plain texts to the same ids; a text that holds a special token's string goes
    to the tokenizer itself, and so does a text that the library's pattern cannot part (about a million
    spaces in a row exhaust its stack), and so do all texts if the file is of another make.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = byte_letters()
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.plain = None
        if merges_in_order(json.loads(self.tokenizer.to_str()), len(ranks)):
            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.plain is not None and not any(x in text for x in self.special):
            try:
                return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), "<u4")
            except ValueError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def merges_in_order(file: dict, tokens: int) -> bool:
    """Whether a tokenizers file has plain byte-level pieces, and each merge makes the token after the one that the merge before made."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not file.get("normalizer")
    by_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    return plain and by_bytes and tokens == 256 + len(pairs) and all(b > a for a, b in zip(made, made[1:])) and made[:1] >= [256]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str) -> ByteBpe:
    """One encoder for all tasks of a worker."""
    return ByteBpe(tokenizer_path)


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                data = encoder.encode(text).tobytes() + end
                n = len(data) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(i, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            index, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece. A null or empty text is its end id alone.

    Of a document longer than capacity the first piece is the shorter one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Sequences that the lengths (each so many times; once if not said) need at least, by two families of dual feasible functions.

    For each threshold t: lengths above capacity - t count as whole sequences, lengths under t as
    nothing, the others as they are. And for k = 1..20: floor((k+1) x / C) / k, unless (k+1) x is a
    multiple of C, when x / C stays.
    """
    if not len(lengths):
        return 0
    order = np.argsort(lengths, kind="stable")
    x = lengths[order].astype(np.int64)
    n = np.ones(len(x), np.int64) if times is None else times[order].astype(np.int64)
    below, number = (np.concatenate([[0], np.cumsum(c)]) for c in (x * n, n))
    best = -(-int(below[-1]) // capacity)
    ts = np.unique(x[x <= capacity // 2])
    if len(ts):
        low = np.searchsorted(x, ts)
        high = np.searchsorted(x, capacity - ts, side="right")
        best = max(best, int((number[-1] - number[high] - (-(below[high] - below[low]) // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        total = int((np.where(exact, x * k, (scaled // capacity) * capacity) * n).sum())
        best = max(best, -(-total // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Ties go by position.

    Open bins are kept by free room, and a big integer has a bit for every room that some bin has,
    so the smallest room that fits is its lowest bit at or above the length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, count


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part long, part_sequences long, part_bound long, released boolean"


def _pack(capacity: int, level: int):
    """A group's pieces packed; released: the sequence may move, as its group is above the bound.

    Of a later level a group holds whole sequences of the level before (sequence_id); if packing
    them again saves none, they stay as they are.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = count - bound
        if level and count >= pdf["sequence_id"].nunique():
            pdf["released"] = gap > 0
            count = pdf["sequence_id"].nunique()
        else:
            pdf["sequence_id"] = (level << 60) + (int(key[0]) << 32) + bins
            pdf["offset"] = offsets
            fill = np.bincount(bins, lengths, count) if count else np.zeros(0)
            order = np.argsort(fill, kind="stable")
            free = np.cumsum(capacity - fill[order])
            loose = np.zeros(count, bool)
            if gap > 0:
                loose[order[: np.searchsorted(free, (gap + 2) * capacity) + 1]] = True
            pdf["released"] = loose[bins] & (fill[bins] < capacity)
        pdf["part"], pdf["part_sequences"], pdf["part_bound"] = (level << 32) + int(key[0]), count, bound
        return pdf[[x.split()[0] for x in PACKED.split(", ")]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK, exchanges: int = EXCHANGES) -> DataFrame:
    """Pieces with sequence_id and offset, and of the partition (part) that packed a piece last its sequences and their lower bound.

    Every piece keeps its row; an empty table gives an empty one. Of an exchange only the pieces that move are written.
    """
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_task))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))
    dealt = dealt.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    done = written(dealt.groupBy("_group").applyInPandas(_pack(capacity, 0), PACKED), "packed")
    settled, loose = [done.where("not released")], done.where("released")
    for level in range(1, exchanges + 1):
        n = loose.count() if groups > 1 else 0
        if not n:
            break
        groups = -(-n // pieces_per_task)
        dealt = loose.withColumn("_group", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)))
        again = written(dealt.groupBy("_group").applyInPandas(_pack(capacity, level), PACKED), "packed")
        settled.append(again.where("not released"))
        loose = again.where("released")
    return reduce(DataFrame.unionByName, settled, loose).drop("released")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """sequences, bound and gap of pack()'s result as a whole: no packing of these pieces has fewer sequences than bound.

    The bound is that of the partitions, over a table of the pieces by length (of which there are at most capacity).
    """
    counts = packed.groupBy("length").agg(F.count("*").alias("n")).collect()
    lengths, times = np.array([r["length"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    bound = lower_bound(lengths, capacity, times)
    sequences = packed.select("sequence_id").distinct().count()
    return {"sequences": sequences, "bound": bound, "gap": sequences - bound}


def packed_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path))


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, with each partition's certificate: its sequences and their lower bound.

    A null or empty text is its end id alone; a text of any length is encoded whole and cut; equal lengths
    are packed in the order of doc_id and piece. Rows that repeat a document are packed as often as they
    come, rows without an id like others. Other columns are not read; an empty table gives no sequence.
    """
    return packed_documents(documents(spark, sf_dir), production_tokenizer())
