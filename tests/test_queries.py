"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from foliant import catalog


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(name, spark, sf_dir, duck):
    got = E.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_entry(spark):
    assert E.entry(spark).count() > 0
