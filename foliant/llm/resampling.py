"""Importance resampling towards a target distribution over hashed word n-grams.

One pass over the texts writes the document-by-bucket count matrix in compressed sparse rows, a
block of documents a row of the table. Its column sums are the raw distribution, the target's matrix
gives the other; their log ratio is a gain for each bucket, and a product of the matrix with the
gains is each document's weight. Gumbel noise of a hash of the id makes the highest scores a draw
without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, raw, written
from .merkle import CRC_TABLE_SQL, crc32_sql
from .running import laid_out

BUCKETS = 10_000
#: Documents, and bytes of their texts, that make one block of the matrix.
BLOCK_ROWS = 256
BLOCK_BYTES = 512 << 10
#: Parquet settings for rows that are large: readers and writers hold a row group and a page, whose sizes are else looked at every 100 rows.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Least words of a document that can be drawn, and the percentage that is drawn.
LEAST_WORDS = 20
DRAWN = 25
SEED = 7
#: a-z, 0-9 and all bytes of letters beyond ASCII are parts of words, A-Z in lower case; the rest parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEPARATOR = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: A block: of its rows the id, words and features; where each row's entries begin (eight bytes each); of each entry its bucket and
#: count, in as few bytes (1, 2, 4 or 8, little-endian) as hold the block's largest.
BLOCKS = "doc_id array<long>, n_words array<long>, n_features array<long>, indptr binary, indices binary, counts binary"


def stretches(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of the words of some limit bytes; no word is cut."""
    begin = 0
    while begin < len(text):
        gap = SEPARATOR.search(text, begin + limit)
        end = gap.start() if gap else len(text)
        yield text[begin:end].translate(LETTERS).split()
        begin = end


def hashes(words: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of each word, and of each with the word before it (before: the last word so far, if there is one)."""
    single = list(map(crc32, words))
    first = list(map(crc32, before)) + single[:-1]
    pairs = map(crc32, [b" " + w for w in words[1 - len(before) :]], first)
    return np.array(single, np.int64), np.fromiter(pairs, np.int64)


def _row(text: bytes, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the buckets and counts of a text."""
    words, features, last, total = 0, 0, [], None
    for part in stretches(text):
        if not part:
            continue
        single, pairs = hashes(part, last)
        words, features, last = words + len(single), features + len(single) + len(pairs), part[-1:]
        found, counts = np.unique(np.concatenate([single, pairs]) % buckets, return_counts=True)
        if total is None and len(text) <= BLOCK_BYTES:
            return words, features, found, counts
        total = np.zeros(buckets, np.int64) if total is None else total
        total[found] += counts
    if total is None:
        return 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return words, features, found, total[found]


def narrow(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0)).newbyteorder("<")).tobytes()


def _matrix(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = raw(batch.column(1)), batch.column(0).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < BLOCK_ROWS and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
                    size += len(texts[end])
                    end += 1
                rows = [_row(t, buckets) for t in texts[at:end]]
                found, counts = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
                ends = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(c, pa.int64())) for c in (ids[at:end], [r[0] for r in rows], [r[1] for r in rows])]
                parts = [ends.astype("<i8").tobytes(), narrow(found), narrow(counts)]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([p], pa.binary()) for p in parts)], [f.split()[0] for f in BLOCKS.split(", ")])
                at = end

    return run


def count_matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The rows' counts of features by bucket, in blocks of compressed sparse rows. A null text is empty; any number of rows and any lengths."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _matrix(buckets), BLOCKS)


def _entries(ends: bytes, indices: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows begin, buckets and counts of a block."""
    ends = np.frombuffer(ends, "<i8")
    of = lambda data: np.frombuffer(data, f"<u{len(data) // ends[-1]}" if data else "<u1").astype(np.int64)
    return ends, of(indices), of(counts)


def _column_sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in zip(*batch.columns):
                _, found, times = _entries(*(x.as_py() for x in block))
                total += np.bincount(found, times, buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return run


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all rows in it. Each task adds up its blocks before the shuffle."""
    return matrix.select("indptr", "indices", "counts").mapInArrow(_column_sums(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw_sums: DataFrame, target_sums: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain: 1000 times the log ratio of the target's to the raw distribution, with one added to each count, rounded down."""
    spark = raw_sums.sparkSession
    both = spark.range(buckets).select(F.col("id").alias("bucket"))
    both = both.join(raw_sums.withColumnRenamed("n", "s"), "bucket", "left").join(target_sums.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    number = lambda c: F.col(c).cast("double") + 1
    ratio = (number("t") * F.lit(float(sums.s + buckets))) / (number("s") * F.lit(float(sums.t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                ids, words, features = (batch.column(c)[b].values for c in ("doc_id", "n_words", "n_features"))
                ends, found, times = _entries(*(batch.column(c)[b].as_py() for c in ("indptr", "indices", "counts")))
                sums, n = np.concatenate([[0], np.cumsum(gain[found] * times)]), features.to_numpy()
                weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(matrix: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight, the mean gain of its features rounded down. Of gain there are as many rows as buckets."""
    vector = np.zeros(buckets, np.int64)
    for row in gain.collect():
        vector[row.bucket] = row.gain
    return matrix.mapInArrow(_weights(vector), "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down. A null id is like an empty one."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and rank of those that are drawn: drawn percent of the rows with least_words words.

    Null and empty texts have no features and weight 0. Equal scores go by doc_id, rows without one last;
    rows that share an id have ranks of their own. Long texts are read in stretches. Other columns are not
    read; an empty table gives an empty one, and with an empty target gains come from the rows alone.
    """
    matrix = written(count_matrix(docs, buckets=buckets), "matrix", **SMALL_GROUPS)
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, "item_id", buckets=buckets), buckets), buckets)
    rows = weights(matrix, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    able = F.when(F.col("n_words") >= least_words, 0).otherwise(1)
    rows = written(rows.select("doc_id", "n_features", "weight", "score", able.alias("group"), F.lit(1).cast("long").alias("one")), "scores")
    n = rows.where("group = 0").count() * drawn // 100
    placed = laid_out(rows, "group", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "one")
    rank = F.when((F.col("group") == 0) & (F.col("before") < n), F.col("before") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words; nulls, ties, repeats, long texts and empty tables as in resampled()."""
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


OP13_SQL = rf"""
WITH t AS ({CRC_TABLE_SQL}),
w AS (
  SELECT 0 AS target, doc_id AS id, words FROM (SELECT doc_id, {_words_sql()} AS words FROM documents)
  UNION ALL SELECT 1, item_id, words FROM (SELECT item_id, {_words_sql()} AS words FROM benchmark)),
r AS (SELECT *, row_number() OVER () AS row FROM w),
f AS (SELECT row, target, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM r),
n AS (SELECT row, target, feature, count(*) AS n FROM f GROUP BY 1, 2, 3),
x AS (SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM n), t),
c AS (SELECT row, target, bucket, sum(n) AS n FROM n JOIN x USING (feature) GROUP BY 1, 2, 3),
s AS (SELECT bucket, sum(n) FILTER (WHERE target = 0) AS s, sum(n) FILTER (WHERE target = 1) AS t FROM c GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) + {BUCKETS} AS s, coalesce(sum(t), 0) + {BUCKETS} AS t FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(s.t, 0) + 1)::DOUBLE * a.s::DOUBLE) / ((coalesce(s.s, 0) + 1)::DOUBLE * a.t::DOUBLE))) AS BIGINT) AS gain FROM s, a),
m AS (SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g FROM c JOIN g USING (bucket) WHERE target = 0 GROUP BY 1),
d AS (SELECT r.id AS doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(CASE WHEN g % n < 0 THEN g // n - 1 ELSE g // n END, 0) AS weight,
        CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(r.id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM r LEFT JOIN m USING (row) WHERE target = 0),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_words >= {LEAST_WORDS} AS able FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) FILTER (WHERE able) OVER () * {DRAWN} // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= drawn THEN rank END AS rank FROM k
"""
