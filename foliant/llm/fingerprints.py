"""SimHash fingerprints in DataFrame operations only, and a search by permuted block tables.

The terms of a text are its word triples (fewer words: the whole sequence as one term), each as often
as it occurs, so a term's count is its weight. Two 64-bit hashes of a term give 128 signs; a
fingerprint's bit is set where the set bits outvote the others. Votes are summed with two
bit positions in one 64-bit number, 32 bits apart.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, salted_join, small, written

WIDTH = 3
SEEDS = (1, 2)
BITS = 64 * len(SEEDS)
#: Documents of a range whose neighbours meet in one task.
RANGE_ROWS = 2_000
#: Ranges of ids on the first level, and parts of each on the second.
FIRST_RANGES, SECOND_RANGES = 256, 4_096
#: Bits that fingerprints of near documents may differ in, and the blocks that they are cut into to find them.
RADIUS, BLOCKS = 3, 5
#: Fingerprints under one prefix of a table that one task compares with all of that prefix.
PREFIX_ROWS = 2_000
LANES = 0x0000000100000001


def with_terms(rows: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """rows without text, one for each term, its words as _w0, _w1, ...; all null for a text without words.

    The words are a column of their own before they are zipped with themselves, so that a text is
    split once; what follows is generated code without a lambda.
    """
    others = [c for c in rows.columns if c != text]
    split = rows.select(*others, F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "").alias("_t"))
    n = F.size("_t")
    shifted = [F.col("_t"), *[F.slice("_t", k + 1, F.greatest(n - k, F.lit(0))) for k in range(1, width)]]
    out = split.select(*others, n.alias("_size"), F.posexplode_outer(F.arrays_zip(*[x.alias(f"_w{k}") for k, x in enumerate(shifted)])).alias("_at", "_z"))
    whole = F.col("_at").isNull() | (F.col("_at") == 0) | (F.col("_at") <= F.col("_size") - width)
    names = out.schema["_z"].dataType.names
    return out.where(whole).select(*others, *[F.col("_z")[x].alias(f"_w{k}") for k, x in enumerate(names)])


def fingerprint(n: Column, votes_of: list[str]) -> Column:
    """The fingerprint as hexadecimal digits: bit i of a hash is set if more than half of n terms have it set."""
    out = []
    for k in range(len(SEEDS)):
        word = F.lit(0).cast("long")
        for i in range(32):
            lanes = F.col(votes_of[32 * k + i])
            low, high = lanes.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(lanes, 32)
            word = word.bitwiseOR(F.when(2 * low > n, F.lit(1 << i)).otherwise(F.lit(0)))
            word = word.bitwiseOR(F.when(2 * high > n, F.shiftleft(F.lit(1).cast("long"), 32 + i)).otherwise(F.lit(0).cast("long")))
        out.append(F.lpad(F.hex(word), 16, "0"))
    return F.lower(F.concat(*out))


def fingerprinted(texts: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """keys and the fingerprint of text as name; a text without words gets all zeros. keys must identify a row."""
    rows = with_terms(texts.select(*keys, text), text)
    columns = [c for c in rows.columns if c.startswith("_w")]
    rows = rows.select(*keys, F.col(columns[0]).alias("_first"), *[F.xxhash64(F.lit(seed), *columns).alias(f"_h{k}") for k, seed in enumerate(SEEDS)])
    sums = [F.sum(F.shiftright(f"_h{k}", i).bitwiseAND(F.lit(LANES))).alias(f"_{32 * k + i}") for k in range(len(SEEDS)) for i in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("_first").alias("_n"), *sums)
    return counted.select(*keys, F.when(F.col("_n") > 0, fingerprint(F.col("_n"), [f"_{i}" for i in range(32 * len(SEEDS))])).otherwise("0" * (BITS // 4)).alias(name))


def bits(digits: Column) -> list[Column]:
    return [F.conv(F.substring(digits, 16 * k + 8 * half + 1, 8), 16, 10).cast("long") for k in range(len(SEEDS)) for half in (0, 1)]


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits(a), bits(b))), F.lit(0)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - distance(a, b) / float(BITS)


def first_cuts(ids: DataFrame, ranges: int) -> list[int]:
    """Ascending ids that part the ids into about `ranges` ranges of equal size."""
    if ranges < 2:
        return []
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return sorted(set(ids.select(F.percentile_approx("id", at, 100 * ranges).alias("q")).first()["q"] or ()))


def search(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at or below key, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))


def ranged(docs: DataFrame, range_rows: int = RANGE_ROWS, first: int = FIRST_RANGES, second: int = SECOND_RANGES) -> DataFrame:
    """docs (id, text) with range1, range2 and part, which rise in this order with (id, hash of text) and hold about range_rows rows.

    The first level are quantiles that the driver takes, at most `first`; the second are quantiles of
    each range of the first, which are found and kept apart: at most `second` numbers a range. An id
    with more than range_rows rows is parted by the hash of its texts.
    """
    n = docs.count()
    wanted = max(1, -(-n // range_rows))
    level1 = min(wanted, first)
    range1 = search(F.col("id"), first_cuts(docs.select("id"), level1))
    ids = docs.select("id", range1.alias("range1"))
    level2 = min(-(-wanted // level1), second)
    at = F.array(*[F.lit(i / level2) for i in range(1, level2)]) if level2 > 1 else None
    cuts = ids.groupBy("range1").agg((F.array_distinct(F.percentile_approx("id", at, 100 * level2)) if level2 > 1 else F.array().cast("array<long>")).alias("cuts"))
    cuts = F.broadcast(written(cuts, "cuts"))  # at most `first` rows of at most `second` numbers
    range2 = F.size(F.filter("cuts", lambda c: c <= F.col("id"))).alias("range2")
    hot = ids.groupBy("range1", "id").agg(F.count("*").alias("rows")).where(F.col("rows") > range_rows).join(cuts, "range1")
    hot = hot.select("range1", range2, F.struct("id", F.ceil(F.col("rows") / range_rows).cast("long").alias("parts")).alias("h"))
    hot = written(hot.groupBy("range1", "range2").agg(F.collect_list("h").alias("hot")), "hot_ids")
    rows = docs.select("id", "text", F.xxhash64("text").alias("hash"), range1.alias("range1")).join(cuts, "range1")
    rows = rows.select("id", "text", "hash", "range1", range2).join(small(hot), ["range1", "range2"], "left")
    # in a range with hot ids: what lies before the first, the first by its parts, what lies up to the second, ...
    before = F.size(F.filter("hot", lambda h: h["id"] < F.col("id"))).cast("long")
    parts = F.get(F.filter("hot", lambda h: h["id"] == F.col("id")), F.lit(0))["parts"]
    share = F.least(F.floor(F.shiftrightunsigned("hash", 1) / F.lit(2.0**63) * parts).cast("long"), parts - 1)
    part = F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(before * (1 << 41) + F.coalesce(share + (1 << 40), F.lit(0).cast("long")))
    return rows.select("id", "hash", "text", "range1", "range2", part.alias("part"))


PLACE = ("range1", "range2", "part")


def in_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS, first: int = FIRST_RANGES, second: int = SECOND_RANGES) -> DataFrame:
    """docs (doc_id, text) with id, PLACE, guest and row, so that the next document by descending doc_id is the row before.

    As guest, each range also gets the last document of the nearest range below that has one; the
    lowest range gets the last of all, as the first document follows the last. Rows without an id
    come lowest; ties of an id go by a hash of the text, then by the text.
    """
    rows = ranged(docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text"), range_rows, first, second)
    order = F.struct("id", F.shiftrightunsigned("hash", 1), "hash")
    tops = written(rows.groupBy(*PLACE).agg(F.max_by(F.struct("id", "hash"), order).alias("t")).select(*PLACE, "t.*"), "tops")
    inside = Window.partitionBy("range1").orderBy("range2", "part")
    after = [F.lead(c).over(inside).alias(f"_{c}") for c in PLACE]
    # from each range of the first level, of which there are few, to the next: the driver knows their order
    ends = sorted(tuple(r) for r in tops.groupBy("range1").agg(F.min(F.struct("range2", "part")).alias("least")).select("range1", "least.*").collect())
    following = [(a[0], *b) for a, b in zip(ends, [*ends[1:], *ends[:1]])]
    listed = ", ".join(map(str, following)) or "(NULL, NULL, NULL, NULL)"
    across = docs.sparkSession.sql(f"SELECT CAST(range1 AS INT) AS range1, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS BIGINT) AS z FROM VALUES {listed} AS t(range1, x, y, z)")
    borders = tops.select("*", *after).join(F.broadcast(across), "range1")
    nowhere = F.col("_range1").isNull()
    borders = borders.select("id", "hash", *[F.when(nowhere, F.col(n)).otherwise(F.col(f"_{c}")).alias(c) for c, n in zip(PLACE, "xyz")])
    borders = written(borders, "borders")
    guests = rows.drop(*PLACE).join(small(borders), ["id", "hash"]).dropDuplicates(["id", "hash", *PLACE])
    columns = ["id", "hash", "text", *PLACE]
    both = rows.select(*columns, F.lit(False).alias("guest")).unionByName(guests.select(*columns, F.lit(True).alias("guest")))
    place = Window.partitionBy(*PLACE).orderBy(F.desc("guest"), "id", F.shiftrightunsigned("hash", 1), "hash", "text")
    return both.withColumn("row", F.row_number().over(place))


def edited_fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every row of docs (doc_id, text): n_chars, edited_sha256, both fingerprints and their likenesses.

    A null text is empty and the fingerprint of a text without words is all zeros. The edited text has
    its last third (rounded down) replaced by as many first characters of the next document, or by
    all that it has. A single document is its own next one. One exchange brings each text to its
    range; windows and sums then stay within the range.
    """
    rows = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), range_rows)
    order = Window.partitionBy(*PLACE).orderBy("row")
    part = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("next", F.coalesce(F.lag("text").over(order), F.lit("")))
    rows = rows.withColumn("edited", F.when(F.col("guest"), "").otherwise(F.concat(F.substr("text", F.lit(1), F.length("text") - part), F.substr("next", F.lit(1), part))))
    keys = [*PLACE, "row", "guest", "id", "n_chars", "edited_sha256"]
    rows = rows.select(*PLACE, "row", "guest", "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "body"))
    prints = fingerprinted(rows, [*keys, "which"], "body", "print")
    pair = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("print"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("print"))).alias("edited_fingerprint"))
    pair = pair.withColumn("_next", F.lag("fingerprint").over(order)).where("not guest")
    doc_id = F.nullif("id", F.lit(-(1 << 63))).alias("doc_id")
    return pair.select(doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))


def within_radius(prints: DataFrame, radius: int, blocks: int | None = None, key: str = "doc_id", name: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): key and class of every row; and classes a < b and their fingerprints fa, fb at 1..radius bits from each other.

    Equal fingerprints are one class, named by its smallest key (null if none has a key); a row without a fingerprint is in none. A fingerprint is cut into blocks;
    two that differ in at most radius bits agree in at least blocks - radius of them, so with a table
    for each choice of so many blocks (the permutation that brings them to the front) every pair
    meets in some table under an equal prefix. Of a table only pairs within the radius leave the join.
    """
    blocks = blocks or radius + 2
    digits = BITS // 4
    if not 0 <= radius < blocks <= digits:
        raise ValueError("radius must be smaller than blocks, and blocks at most the digits of a fingerprint")
    classes = written(prints.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("class")), "classes")
    edges = [digits * i // blocks for i in range(blocks + 1)]
    cut = [F.substring(name, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
    tables = [F.struct(F.lit(t).alias("table"), F.concat(*[cut[i] for i in chosen]).alias("prefix")) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    rows = classes.select("class", name, F.explode(F.array(*tables)).alias("x")).select("class", name, "x.*")
    left = rows.select("table", "prefix", F.col("class").alias("a"), F.col(name).alias("fa"))
    right = rows.select("table", "prefix", F.col("class").alias("b"), F.col(name).alias("fb"))
    near = (left["table"] == right["table"]) & (left["prefix"] == right["prefix"]) & (F.col("fa") < F.col("fb")) & (distance(F.col("fa"), F.col("fb")) <= radius)
    rising = F.col("a") <= F.col("b")
    pairs = left.join(right, near).select("fa", "fb", F.when(rising, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(rising, F.col("b")).otherwise(F.col("a")).alias("b"), distance(F.col("fa"), F.col("fb")).alias("bits")).distinct()
    return salted_join(prints.select(key, name), classes, name, key).select(key, "class"), written(pairs, "pairs")


def neighbour_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, name: str = "fingerprint", rows_a_part: int = PREFIX_ROWS) -> DataFrame:
    """name and n_near (over 0) of each different fingerprint: how many others lie within radius bits of it.

    The tables are those of within_radius(), but no pair is written or leaves its task: a pair counts in the
    first of the tables in which it meets, and what leaves the join are sums. Fingerprints under a prefix
    that more than rows_a_part of them share, such as those of many slightly different copies, are parted:
    each part meets all of them, in a task of its own.
    """
    if not 0 <= radius < blocks <= BITS // 4:
        raise ValueError("radius must be smaller than blocks, and blocks at most the digits of a fingerprint")
    digits = BITS // 4
    edges = [digits * i // blocks for i in range(blocks + 1)]
    cut = lambda c, i: F.substring(c, edges[i] + 1, edges[i + 1] - edges[i])
    choices = list(combinations(range(blocks), blocks - radius))
    prefixes = [F.struct(F.lit(t).alias("table"), F.concat(*[cut(F.col("f"), i) for i in chosen]).alias("prefix")) for t, chosen in enumerate(choices)]
    words = [f"b{k}" for k in range(2 * len(SEEDS))]
    different = prints.where(F.col(name).isNotNull()).select(F.col(name).alias("f")).distinct()
    rows = written(different.select("f", *[w.alias(n) for w, n in zip(bits(F.col("f")), words)], F.explode(F.array(*prefixes)).alias("x")).select("f", *words, "x.*"), "prefixes")
    shared = rows.groupBy("table", "prefix").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = written(shared.withColumn("parts", F.ceil(F.col("rows") / rows_a_part).cast("int")).drop("rows"), "shared")
    rows = rows.join(small(shared), ["table", "prefix"])
    left = rows.withColumn("part", F.pmod(F.xxhash64("f"), "parts").cast("int")).drop("parts").alias("l")
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("table", "prefix", "part", F.col("f").alias("g"), *[F.col(w).alias(f"g{w}") for w in words])
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"g{w}"))) for w in words), F.lit(0))
    # the first table of a pair is that of the first blocks in which they agree
    earlier = F.lit(False)
    for t, chosen in enumerate(choices):
        agree = [cut(F.col("f"), i) == cut(F.col("g"), i) for i in range(chosen[-1]) if i not in chosen]
        for x in agree:
            earlier = earlier | ((F.col("table") == t) & x)
    met = left.join(right, ["table", "prefix", "part"]).where((apart <= radius) & (F.col("f") != F.col("g")) & ~earlier)
    return met.groupBy(F.col("f").alias(name)).agg(F.count("*").alias("n_near"))


def with_neighbours(rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, key: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """rows with n_near: how many other fingerprints of rows lie within radius bits of its own."""
    counts = written(neighbour_counts(rows, radius, blocks, name), "neighbours")
    return salted_join(rows, counts, name, key).withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints() of every document, with the number of other fingerprints within RADIUS bits; nulls, empty and repeated texts and empty tables as there."""
    prints = written(edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text")), "fingerprints")
    columns = prints.columns
    return with_neighbours(prints).select(*columns, "n_near")
