"""Quality rules whose cutoffs are chosen on labelled holdouts with a guarantee.

A rule is a measure of a text and a list of cutoffs from lenient to strict; a document above the
cutoff is rejected. For each stratum and rule, cutoffs are tested in that fixed order: "more than
e of the good documents of this stratum are rejected" is refuted by the exact binomial tail of the
good labelled documents that a cutoff rejects. Testing stops at the first cutoff that is not
refuted, so the order itself costs no correction; over strata and rules, Bonferroni's corrects.
Which rules are tested in a stratum is told by the bad labelled documents alone (a rule that rejects
none of them gains nothing), which the tests on the good ones do not depend on. With the allowed
share split evenly over a stratum's tested rules, all rules together falsely reject at most
max_false_rejection of its good documents, in all strata at once, with probability confidence. Among
certified cutoffs the one with the most rejected bad documents for its rejected good ones is taken,
the more lenient in a tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, raw, small, written

#: Measures and their cutoffs from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03),
    "capitals_share": (0.95, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1),
    "marks_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03),
    "echoes_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "repeated_share": (0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "dup_lines_share": (0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
MAX_FALSE_REJECTION = 0.02
CONFIDENCE = 0.95
#: Bad documents that must be caught for each good one that a cutoff costs on the holdout.
GAIN = 10.0

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_marks long, n_echoes long, n_lines long"
SPACE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Positions covered by a window of width words that occurs twice or more, the first time included."""
    n = len(ids)
    if n <= width:
        return 0
    base = int(ids.max()) + 1
    windows = ids[: n - width + 1]
    bound = base
    for k in range(1, width):
        if bound >= (1 << 62) // base:
            windows = np.unique(windows, return_inverse=True)[1]
            bound = int(windows.max()) + 1
        windows = windows * base + ids[k : n - width + 1 + k]
        bound *= base
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The values of FEATURES for one text in UTF-8."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    bare = text.translate(None, SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    return (
        len(words),
        chars,
        size - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(seen) < len(words) else 0,
        size - len(text.translate(None, CAPITALS)),
        text.count(b"!"),
        int((ids[1:] == ids[:-1]).sum()),
        len(lines),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([measures(x) for x in raw(batch.column(2))], np.int64).reshape(-1, 9)
        names = [x.split()[0] for x in FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(values[:, k]) for k in range(9)), batch.column(3)], ["doc_id", "stratum", *names, "row_key"])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum (null: empty), FEATURES and row_key (see row_key) of every row; a null text counts as empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"), row_key(key, text).alias("row_key"))
    return map_arrow(rows, _measure, f"doc_id long, stratum string, {FEATURES}, row_key string")


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart whose verdicts can differ: id and text, also if either is null."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("none")), F.coalesce(F.col(text), F.lit(""))))


def measure(rule: str) -> Column:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "capitals_share": share("n_capitals", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "echoes_share": share("n_echoes", "n_words"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "dup_lines_share": share("n_dup_lines", "n_lines"),
    }[rule]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from its largest term down."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0  # above the mean nothing is certified; the value only has to be large
    total, i = 0.0, k
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = 1.0
    while i >= 0 and term > 1e-18:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, math.exp(log_term) * total)


def levels(rule: str, cutoffs: tuple[float, ...]) -> Column:
    """How many of the rule's cutoffs the measure exceeds: 1 if only the strictest, all if also the most lenient."""
    value = measure(rule)
    return sum((value > c).cast("int") for c in cutoffs)


def calibrate(table: DataFrame, labels: DataFrame, rules: dict[str, tuple[float, ...]] = RULES, max_false_rejection: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE, gain: float = GAIN) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>) of every labelled stratum, from features and (doc_id, quality 0/1).

    All labelled rows that the base rules keep count: the bound holds for what the rules reject of those (false_rejections()
    reports the whole). Labels without doc_id or quality are left out; a document labelled more
    than once counts once, as bad if any label says so. Only counts by stratum, rule and level leave
    the executors' aggregation.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = table.where(~base_failed()).join(marks, "doc_id")
    stacked = known.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), levels(r, c).alias("level")) for r, c in rules.items()])).alias("x"))
    counts = written(stacked.select("stratum", "quality", "x.*").groupBy("stratum", "rule", "level").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")), "levels")
    tests = max(1, counts.where("level > 0 and bad > 0").select("stratum", "rule").distinct().count())
    alpha = 1 - confidence

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {}
        active = set(pdf.loc[(pdf["level"] > 0) & (pdf["bad"] > 0), "rule"])
        share = max_false_rejection / max(1, len(active))
        for rule, cutoffs in rules.items():
            if rule not in active:
                continue
            part = pdf[pdf["rule"] == rule]
            good, bad = np.zeros(len(cutoffs) + 1, np.int64), np.zeros(len(cutoffs) + 1, np.int64)
            np.add.at(good, part["level"].to_numpy(), part["good"].to_numpy())
            np.add.at(bad, part["level"].to_numpy(), part["bad"].to_numpy())
            n = int(good.sum())
            best = 0.0
            for j, cutoff in enumerate(cutoffs):
                above = len(cutoffs) - j  # a value over this cutoff is over the stricter ones too
                k, caught = int(good[above:].sum()), int(bad[above:].sum())
                if binomial_tail(k, n, share) > alpha / tests:
                    break
                if caught - gain * k > best:
                    best, out[rule] = caught - gain * k, cutoff
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "cutoffs": [out]})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoffs map<string,double>")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def false_rejections(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum, of rows labelled good: n_good, by_base and by_rules (rejected by the base rules, and by the others alone) and share, all rejected of all.

    verdicts is what judged() gives. Rows without a label, and labels with nulls, do not count.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality > 0")
    rows = verdicts.join(good.select("doc_id"), "doc_id")
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n_good"), F.count_if("base_failed").alias("by_base"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("by_rules"))
    return counts.withColumn("share", (F.col("by_base") + F.col("by_rules")) / F.col("n_good"))


def judged(table: DataFrame, chosen: DataFrame, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """features with base_failed, kept and rejected_by (rules whose cutoff the document exceeds)."""
    chosen = written(chosen, "cutoffs")
    over = F.array_compact(F.array(*[F.when(measure(r) > F.col("cutoffs")[r], F.lit(r)) for r in rules]))
    out = table.join(small(chosen), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("rejected_by", F.coalesce(over, F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and verdict of every row of docs. A stratum without enough labels has no cutoffs, so only the base rules reject there."""
    table = written(features(docs), "features")
    return judged(table, calibrate(table, labels))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality() of every document by the labels of the same tables; nulls, repeats and empty tables as in features() and calibrate()."""
    out = quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    rejected = written(quality(docs, labels).where("not kept").select(F.col("row_key").alias("_row")), "rejected")
    return docs.join(small(rejected), row_key() == F.col("_row"), "left_anti")


def _sql() -> str:
    """The query in SQL: base measures by lists of words, levels, exact tails by logarithms of the gamma function, cutoffs."""
    sources = {"symbols_per_word": ("n_symbols", "n_words"), "capitals_share": ("n_capitals", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "echoes_share": ("n_echoes", "n_words"), "repeated_share": ("n_repeat_words", "n_words"), "dup_lines_share": ("n_dup_lines", "n_lines")}
    values = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0 END AS {r}" for r, (a, b) in sources.items())
    cuts = ", ".join(f"('{r}', {j}, CAST({c!r} AS DOUBLE))" for r, cs in RULES.items() for j, c in enumerate(cs))
    measured = " UNION ALL ".join(f"SELECT k, doc_id, stratum, bf, '{r}' AS rule, {r} AS v FROM m" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
gs AS (SELECT k, i, list_slice(w, i, i + 4) AS g FROM g),
gc AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM gs) WHERE c > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + 5)) AS p FROM gc) GROUP BY 1),
f AS (SELECT w.k, doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_marks, len(l.l) AS n_lines,
  coalesce(list_sum(list_transform(range(2, len(w.w) + 1), lambda i: CAST(w.w[i] = w.w[i - 1] AS INT))), 0) AS n_echoes
  FROM w JOIN l ON l.k = w.k LEFT JOIN rep ON rep.k = w.k),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS bf, {values} FROM f),
v AS ({measured}),
cuts(rule, j, c) AS (VALUES {cuts}),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
tested AS (SELECT v.stratum, v.rule, cuts.j, cuts.c, count(*) FILTER (q > 0) AS n, count(*) FILTER (q > 0 AND v > c) AS fp, count(*) FILTER (q <= 0 AND v > c) AS tp FROM v JOIN lab USING (doc_id) JOIN cuts USING (rule) WHERE NOT bf GROUP BY 1, 2, 3, 4),
active AS (SELECT stratum, rule FROM tested GROUP BY 1, 2 HAVING max(tp) > 0),
share AS (SELECT stratum, {MAX_FALSE_REJECTION} / count(*) AS e FROM active GROUP BY 1),
tails AS (SELECT t.*, CASE WHEN fp > n * e THEN 1 ELSE list_sum(list_transform(range(0, fp + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(e) + (n - i) * ln(1 - e)))) END AS p FROM tested t JOIN active USING (stratum, rule) JOIN share USING (stratum)),
certified AS (SELECT *, max(CAST(p > {1 - CONFIDENCE!r} / (SELECT count(*) FROM active) AS INT)) OVER (PARTITION BY stratum, rule ORDER BY j) AS stopped FROM tails),
chosen AS (SELECT stratum, rule, arg_max(c, (tp - {GAIN} * fp) * 1000 - j) AS c FROM certified WHERE stopped = 0 AND tp - {GAIN} * fp > 0 GROUP BY 1, 2),
hit AS (SELECT DISTINCT v.k, v.rule FROM v JOIN chosen USING (stratum, rule) WHERE v.v > chosen.c),
names AS (SELECT k, string_agg(rule, ',' ORDER BY list_position([{", ".join(repr(r) for r in RULES)}], rule)) AS r FROM hit GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND names.r IS NULL AS kept, coalesce(names.r, '') AS rejected_by FROM m LEFT JOIN names ON names.k = m.k
"""


OP1_SQL = _sql()
