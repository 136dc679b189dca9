"""From raw documents to packed sequences, as stages that each read what the one before has kept.

The harness writes each stage's result as Parquet and reads it again as the next one's docs; run()
does the same in the shared folder. Stages but the last return the columns of documents; others, whatever their
names, are left behind by the first, and an empty table goes through as one. No stage's
rows can be written in SQL as a whole, so ORACLE_SQL is None and tests/llm holds the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import minhash, packing, pii, quality_rules, suffix_dedup
from foliant.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as text now has; of a null text as it was."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs certified on the labels of this input.

    A null or empty text has no words and goes; rows that share an id are judged by their own texts.
    """
    return quality_rules.kept_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates (five-word shingles, similarity 0.8 or more).

    Texts without words, and rows without an id, are in no class and stay; equal rows stay once.
    """
    return minhash.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches of 200 bytes or more that also come elsewhere.

    Every row stays, with an empty text if all of it is repeated; a null text stays null.
    """
    return _counted(suffix_dedup.without_repeats(docs.select(*COLUMNS)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kinds. Every row stays; a null text stays null."""
    return _counted(pii.redacted(docs.select(*COLUMNS)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row for each piece, as op9_packing has them. A null or empty text is its end id alone."""
    return packing.packed_documents(docs, packing.production_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
