"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of 2^m slots. Slot k stands at van der Corput's point of k (its m bits
reversed), and the source whose part of the cumulative targets holds the point fills it. As the
points of 2^m slots are all multiples of 2^-m, a source's slots are arithmetic progressions, one for
each dyadic cell of its part; so slots and their ranks within a source are computed in parallel,
without a sort and without the other sources. A source's documents stand in a shuffled order, word
after word, once more from the start when they end; cut into as many equal blocks as it has slots,
block j goes to its slot of rank j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written
from .running import keyed, laid_out

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
REPEATS = 3
#: Words of a block, at most (on average over all sources).
BLOCK_WORDS = 1024
#: Slots in a row that goes to one task, and rows that go there.
CHUNK = 4096
CHUNKS = 16


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """key, source_size -> also nth (from 0, by key), target and quota (target in whole words), cum_quota, all_quota, n_keys.

    All sizes together are shared by weight; a target stops at repeats times the source's size, and the
    excess goes to the others by weight. Sorted by what a weight's unit can take, the stopped sources come
    first, so one pass over the sources finds the common rate of the rest. One row a source in one task.
    """
    by_key, everything = Window.orderBy("key"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("nth", F.row_number().over(by_key) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    total = lambda c: F.sum(c).over(everything)
    rate = (total("source_size") - sum_before("cap")).cast("double") / (total("weight") - sum_before("weight")).cast("double")
    s = s.withColumn("rate", rate).withColumn("stopped", F.col("cap").cast("double") <= F.col("weight") * F.col("rate"))
    s = s.withColumn("rate", F.max(F.when(~F.col("stopped"), F.struct(-F.col("cap") / F.col("weight"), -F.col("nth"), "rate"))).over(everything)["rate"])
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rate"))
    s = s.withColumn("target", target).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"cum_quota": F.sum("quota").over(upto), "all_quota": total("quota"), "n_keys": F.count("*").over(everything)})
    return s.select("key", "source_size", "nth", "target", "quota", "cum_quota", "all_quota", "n_keys")


def bits(words: int, keys: int, block_words: int = BLOCK_WORDS) -> int:
    """m: so many that 2^m blocks of at most block_words hold the mix, and each source can have a slot."""
    return max(-(-words // block_words) - 1, keys - 1, 0).bit_length()


def with_cells(shared: DataFrame, m: int) -> DataFrame:
    """shares() with each source's part [low, high) of the 2^m points, its slots, and the dyadic cells of its part.

    Each source has one point, and the others are dealt by quota. A cell is a residue and a number of
    bits: its slots are those whose lowest bits are the residue.
    """
    points = F.when(F.col("cum_quota") == F.col("all_quota"), F.lit(float(2**m)) - F.col("n_keys")).otherwise((F.lit(float(2**m)) - F.col("n_keys")) * F.col("cum_quota") / F.greatest("all_quota", F.lit(1)))
    high = (F.col("nth") + 1 + F.floor(points)).cast("long")
    s = shared.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("nth")), F.lit(0).cast("long")))
    # going up from level 0, a part's left end leaves a cell where its number is odd, its right end likewise
    ends = F.transform(F.sequence(F.lit(0), F.lit(m)), lambda l: F.struct(l.alias("l"), F.call_function("shiftright", F.col("low") - 1, l) + 1, F.call_function("shiftright", "high", l)))
    ends = F.transform(ends, lambda e: F.struct(e["l"].alias("l"), e["col2"].alias("left"), e["col3"].alias("right")))
    left = F.transform(F.filter(ends, lambda e: (e["left"] < e["right"]) & (e["left"] % 2 == 1)), lambda e: F.struct(e["l"].alias("l"), e["left"].alias("cell")))
    right = F.transform(F.filter(ends, lambda e: (e["left"] < e["right"]) & (e["right"] % 2 == 1)), lambda e: F.struct(e["l"].alias("l"), (e["right"] - 1).alias("cell")))
    reversed_bits = lambda c, n: F.coalesce(F.conv(F.reverse(F.lpad(F.bin(c), n, F.lit("0"))), 2, 10).cast("long"), F.lit(0).cast("long"))
    cells = F.transform(F.concat(left, right), lambda c: F.struct(reversed_bits(c["cell"], F.lit(m) - c["l"]).alias("residue"), (F.lit(m) - c["l"]).alias("bits")))
    return s.withColumns({"slots": F.col("high") - F.col("low"), "cells": cells})


def schedule(sources: DataFrame, m: int) -> DataFrame:
    """key, slot, rank of all 2^m slots: rank counts the source's slots before."""
    rows = sources.select("key", "cells", F.explode("cells").alias("cell"))
    chunks = F.expr(f"sequence(0L, (shiftleft(1L, {m} - cell.bits) - 1) div {CHUNK})")
    # their number is given, as rows that are few and small now become many
    rows = rows.select("key", "cells", "cell", F.explode(chunks).alias("chunk")).repartition(max(1, 2**m // (CHUNK * CHUNKS)), "key", "cell", "chunk")
    within = F.expr(f"sequence(chunk * {CHUNK}L, least((chunk + 1) * {CHUNK}L, shiftleft(1L, {m} - cell.bits)) - 1)")
    rows = rows.select("key", "cells", "cell", F.explode(within).alias("i"))
    rows = rows.select("key", "cells", F.expr("cell.residue + shiftleft(i, cell.bits)").alias("slot"))
    rank = F.expr("aggregate(cells, 0L, (n, c) -> n + greatest(0L, shiftright(slot - c.residue + shiftleft(1L, c.bits) - 1, c.bits)))")
    return rows.select("key", "slot", rank.alias("rank"))


def _block(word: Column) -> Column:
    """The block that a word of a source's stream is in: the first `more` of its blocks have one word more."""
    long_part = F.col("more") * (F.col("each") + 1)
    return F.when(word < long_part, F.expr("0L") + F.floor(word / (F.col("each") + 1))).otherwise(F.col("more") + F.floor((word - long_part) / F.greatest("each", F.lit(1)))).cast("long")


def counted(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, key (of the source, null last), size (words; a null text has none) and shuffle, the place of a document in its source's order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("key"), size.alias("size"), F.substring(name, 1, 16).alias("shuffle"))


class Mix:
    """rows: each document with its place (before) in its source's shuffled order. slots: key, slot, rank. sources: targets and quotas."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS):
        rows = written(counted(docs, seed), "sizes")
        shared = written(shares(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, repeats), "shares")
        most = shared.agg(F.max("all_quota").alias("words"), F.max("n_keys").alias("keys")).first()
        self.m = bits(most.words or 0, most.keys or 0, block_words)
        self.repeats = repeats
        self.sources = written(with_cells(shared, self.m), "sources")
        self.slots = schedule(self.sources.where("all_quota > 0"), self.m)
        narrow = self.sources.select("key", "source_size", "target", "quota", (F.expr("quota div slots")).alias("each"), (F.col("quota") % F.col("slots")).alias("more"))
        self.rows = keyed(laid_out(rows, "key", ["shuffle", "doc_id", "size"], "size"), written(narrow, "quotas"), "key", "before")

    def pieces(self) -> DataFrame:
        """What the slots take: of each document and epoch the blocks that its words are in, with slot, rank, start (word in the document) and length."""
        taking = self.rows.where("size > 0 and before < quota").withColumn("row", F.monotonically_increasing_id())
        r = written(taking, "taking").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1))))
        r = r.withColumn("first", F.col("epoch") * F.col("source_size") + F.col("before")).where("first < quota")
        r = r.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("quota")) - 1)
        r = r.withColumn("rank", F.explode(F.sequence(_block(F.col("first")), _block(F.col("last")))))
        begin = F.col("rank") * F.col("each") + F.least("rank", "more")
        end = begin + F.col("each") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0)
        r = r.withColumns({"begin": F.greatest(begin, "first"), "end": F.least(end, F.col("last") + 1)})
        r = r.select("row", "doc_id", "key", "size", "source_size", "target", "epoch", "rank", (F.col("begin") - F.col("first")).alias("start"), (F.col("end") - F.col("begin")).alias("length"))
        # a plan takes the slots for as few as the sources that they are made from, and would broadcast them
        return r.join(self.slots.hint("merge"), ["key", "rank"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken and first_slot of every document, also of those that no slot takes."""
        of_row = ["row", "doc_id", "size", "source_size", "target"]
        got = self.pieces().groupBy(*of_row).agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot")).drop("row")
        rest = self.rows.where("not (size > 0 and before < quota)").select(*of_row[1:], F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
        return got.unionByName(rest)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the first slot that takes some.

    A null text has no words, a null source is a source (the last one), a null id is shuffled as '-'.
    Rows that share an id are dealt as they are; which of two equal ones is taken more often is the same
    in each run up to their exchange. Long texts go over many blocks. Only doc_id, source and text are
    read, whatever other columns there are; an empty table gives an empty mix.
    """
    return Mix(documents(spark, sf_dir)).taken()


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS key, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size, substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 16) AS shuffle FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS nth, 3 * n AS cap FROM s),
v AS (SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS BIGINT) AS weight, sum(n) OVER () AS t FROM w),
o AS (SELECT *, CAST(t - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS rate, row_number() OVER (ORDER BY cap / weight, key) AS ord
      FROM v WINDOW b AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) <= weight * rate AS stopped FROM o),
l AS (SELECT *, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE weight * min_by(rate, ord) FILTER (WHERE NOT stopped) OVER () END AS target FROM c),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM l),
u AS (SELECT *, sum(quota) OVER (ORDER BY key) AS cum, sum(quota) OVER () AS total, count(*) OVER () AS keys FROM q),
m AS (SELECT len(bin(greatest((max(total) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} - 1, max(keys) - 1, 0))) AS m, max(keys) AS keys, greatest((max(total) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} - 1, max(keys) - 1, 0) = 0 AS one FROM u),
p AS (SELECT CASE WHEN one THEN 0 ELSE m END AS m, CASE WHEN one THEN 1 ELSE 1 << m END AS points FROM m),
h AS (SELECT u.*, nth + 1 + CAST(floor(CASE WHEN cum = total THEN CAST(points AS DOUBLE) - keys ELSE (CAST(points AS DOUBLE) - keys) * cum / total END) AS BIGINT) AS high FROM u, p),
g AS (SELECT *, coalesce(lag(high) OVER (ORDER BY nth), 0) AS low FROM h),
x AS (SELECT k AS slot, CASE WHEN m = 0 THEN 0 ELSE CAST('0b' || reverse(lpad(bin(k), CAST(m AS INTEGER), '0')) AS BIGINT) END AS point FROM p, unnest(range(0, points)) AS r(k)),
y AS (SELECT key, slot, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM x JOIN g ON point >= low AND point < high),
z AS (SELECT d.*, n, target, quota, high - low AS slots, quota // (high - low) AS each, quota % (high - low) AS more, coalesce(sum(size) OVER (PARTITION BY key ORDER BY shuffle, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g USING (key)),
f AS (SELECT *, CASE WHEN size > 0 AND before < quota THEN CASE WHEN before < more * (each + 1) THEN before // (each + 1) ELSE more + (before - more * (each + 1)) // greatest(each, 1) END END AS rank FROM z)
SELECT doc_id, size, n AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE CAST((quota // n) * size + greatest(0, least(before + size, quota % n) - before) AS BIGINT) END AS taken, slot AS first_slot
FROM f LEFT JOIN y ON y.key = f.key AND y.rank = f.rank
"""
