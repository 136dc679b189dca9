"""The corpus queries that SQL can express, against it, on the smallest tables."""

from __future__ import annotations

import pandas as pd
import pytest

from foliant.llm import queries as Q
from test_queries import normal


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_source_mix", "op13_importance_resampling"])
def test_equals_sql(name, spark, sf_dir, duck):
    got, want = Q.queries()[name](spark, sf_dir).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_scopes_of_two_threads_do_not_meet(spark):
    """A table that one thread writes is not deleted at the end of the other's scope."""
    import threading

    from foliant.llm import common

    opened, closed, out = threading.Event(), threading.Event(), {}

    def other():
        opened.wait(60)
        out["table"] = common.written(spark.range(5), "other")
        closed.wait(60)
        out["count"] = out["table"].count()

    thread = threading.Thread(target=other)
    thread.start()
    with common.scope(spark):
        own = common.written(spark.range(3), "own")
        opened.set()
        while "table" not in out:
            closed.wait(0.05)
        assert own.count() == 3
    closed.set()
    thread.join(60)
    assert out["count"] == 5
    with pytest.raises(Exception):
        own.count()
