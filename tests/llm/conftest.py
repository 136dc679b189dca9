from __future__ import annotations

import pytest

EDGE = [
    (1, "one two three four five six seven eight nine ten", "en", "s", 10),
    (2, "", "en", "s", 0),
    (3, None, None, None, None),
    (4, "x " * 30_000, "en", "s", 60_000),
    (5, "same words here in a row of ten or more now", "en", "s", 1),
    (6, "same words here in a row of ten or more now", "en", "s", 1),
    (6, "same words here in a row of ten or more now", "en", "s", 1),
    (None, "a row without an id has ten words or more here", "de", "s", 1),
    (7, "\t \n", "", "s", 3),
    (8, "ünïcödé 日本語 🙂 text", "fr", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and other columns whose names the operators use themselves."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.selectExpr("*", "'k' AS kept", "'t' AS tid", "1 AS row", "2 AS key", "'b' AS block", "'c' AS component", "'d' AS _spans", "7 AS n")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
