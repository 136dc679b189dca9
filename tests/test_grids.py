"""Cells that span: each place of a grid once, against brute force; HTML; boxes of three forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import boxes as B
from foliant.operators import grids as G

SCHEMA = "doc_id long, page int, row int, col int, text string"


def brute(places: dict) -> set:
    """row, col, rowspan, colspan, text: right over empty places, then down while all places up to the end are empty."""
    rows, cols = max(r for r, _ in places) + 1, max(c for _, c in places) + 1
    full = {k: v.strip() for k, v in places.items() if v and v.strip()}
    out, covered = set(), set()
    for (r, c), text in full.items():
        w = 1
        while c + w < cols and (r, c + w) not in full:
            w += 1
        h = 1
        while r + h < rows and all((r + h, k) not in full for k in range(c + w)):
            h += 1
        out.add((r, c, h, w, text))
        area = {(r + i, c + k) for i in range(h) for k in range(w)}
        assert not area & covered
        covered |= area
    for r in range(rows):
        for c in range(cols):
            if (r, c) not in covered:
                out.add((r, c, 1, 1, ""))
    return out


def test_spans_cover_every_place_once(spark):
    rng = random.Random(1)
    tables = {}
    for t in range(150):
        rows, cols, share = rng.randrange(1, 6), rng.randrange(1, 6), rng.random()
        places = {(r, c): rng.choice(["x", " y ", "z"]) if rng.random() < share else rng.choice(["", " ", None]) for r in range(rows) for c in range(cols) if rng.random() < 0.9}
        if places:
            tables[t] = places
    rows = [(t, 0, r, c, text) for t, places in tables.items() for (r, c), text in places.items()]
    got: dict = {}
    for x in G.spans(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.doc_id, set()).add((x.row, x.col, x.rowspan, x.colspan, x.text))
    assert got == {t: brute(p) for t, p in tables.items()}
    assert G.spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_html(spark):
    rows = [(1, 0, 0, 0, "Col1"), (1, 0, 0, 2, "a<b & c"), (1, 0, 1, 2, "V" * 201), (2, 0, 0, 0, "only")]
    got = {r.doc_id: r.html for r in G.html(G.spans(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1] == "\n".join(['<table class="table">', "<thead>", "<tr>", '<td rowspan="2" colspan="2">Col1</td>', "<td>a&lt;b &amp; c</td>", "</tr>", "</thead>", "<tbody>", "<tr>", "<td>" + "V" * 200 + "...</td>", "</tr>", "</tbody>", "</table>"])
    assert got[2] == "\n".join(['<table class="table">', "<tbody>", "<tr>", "<td>only</td>", "</tr>", "</tbody>", "</table>"])


def test_a_table_is_gathered_once(spark, sf_dir):
    """One sort's worth of rows a task: the lines are read and dealt once, and no window, second branch or second gathering holds them beside it."""
    import __spark_entry__ as E

    plan = E.queries()["table_html"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("FileScan", "Exchange", "Window", "Sort ", "Union", "ObjectHashAggregate")] == [1, 1, 0, 0, 0, 2]
    assert plan.count("trim(") == 1


def test_wide_and_long_tables_with_few_texts(spark):
    rng = random.Random(3)
    tables = {t: {(r, c): "x" if rng.random() < share else "" for r in range(rows) for c in range(cols)} for t, (rows, cols, share) in enumerate([(40, 3, 0.1), (3, 40, 0.1), (25, 25, 0.02), (25, 25, 0.9), (12, 12, 0.0)])}
    df = spark.createDataFrame([(t, 0, r, c, text) for t, places in tables.items() for (r, c), text in places.items()], SCHEMA).cache()
    got: dict = {}
    for x in G.spans(df).collect():
        got.setdefault(x.doc_id, set()).add((x.row, x.col, x.rowspan, x.colspan, x.text))
    assert got == {t: brute(p) for t, p in tables.items()}
    assert sorted(G.html_of(G.grids(df)).collect()) == sorted(G.html(G.spans(df)).collect())


@pytest.mark.parametrize(("x", "w", "width", "middle"), [(100, 200, 400, True), (0, 100, 400, False), (141, 100, 400, True), (139, 100, 400, True), (161, 100, 400, True), (200, 100, 400, False), (0, 10, 0, False)])
def test_places_are_the_same_in_all_three_forms(spark, x, w, width, middle):
    y, h = 40, 20
    points = [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    df = spark.createDataFrame([(points, x, y, w, h, width)], "p array<struct<x:double,y:double>>, x int, y int, w int, h int, width int")
    c = F.col
    forms = [B.of_points(c("p")), B.of_size(c("x"), c("y"), c("w"), c("h")), B.of_corners(c("x") + c("w"), c("y") + c("h"), c("x"), c("y"))]
    row = df.select(*[B.centred(f, c("width")).alias(f"c{i}") for i, f in enumerate(forms)], *[B.at_top(f, F.lit(1000)).alias(f"t{i}") for i, f in enumerate(forms)], *[f.alias(f"b{i}") for i, f in enumerate(forms)]).first()
    assert row.b0 == row.b1 == row.b2 and (row.c0, row.c1, row.c2) == (middle,) * 3 and row.t0 and row.t1 and row.t2


def test_no_box_is_no_place(spark):
    df = spark.createDataFrame([([], None)], "p array<struct<x:double,y:double>>, x int")
    none = F.lit(None).cast("int")
    row = df.select(B.centred(B.of_points(F.col("p")), F.lit(100)).alias("a"), B.at_top(B.of_size(none, none, none, none), F.lit(100)).alias("b"), B.of_corners(none, none, none, none).alias("c")).first()
    assert tuple(row) == (False, False, None)


def test_scores_have_one_exchange_of_the_blocks(spark):
    from foliant.operators import scores

    rows = spark.range(30).selectExpr("id % 3 AS doc_id", "CAST(id % 2 AS INT) AS page", "CAST(id AS INT) AS idx", "concat('1. ', id) AS text", "90 AS conf", "1 AS x", "CAST(id AS INT) AS y", "20 AS h")
    plan = scores.counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Join") == 0


def test_scores_shuffle_no_text_and_count_symbols_as_the_pattern_does(spark):
    from foliant.functions import text as T
    from foliant.operators import scores

    rng = random.Random(7)
    lines = ["", None, *("".join(rng.choices("aé字🙂 \t٣0123456789.,;:()（）-+%/℃㎡", k=rng.randrange(1, 40))) + "x" * rng.randrange(60) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    old = F.length(F.regexp_replace("text", T.TABLE_SYMBOLS, "")) / F.greatest(F.length("text"), F.lit(1)) > 0.25
    got = df.select(T.dense_in_symbols(F.col("text")).alias("a"), old.alias("b"), T.list_item(F.col("text"))["type"].alias("c"), T.list_type(T.stripped(F.col("text"))).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and {r.a for r in got} == {True, False, None}
    rows = spark.range(30).selectExpr("id % 3 AS doc_id", "CAST(id % 2 AS INT) AS page", "CAST(id AS INT) AS idx", "concat('1. ', id) AS text", "90 AS conf", "1 AS x", "CAST(id AS INT) AS y", "20 AS h")
    plan = scores.counts(rows)._jdf.queryExecution().executedPlan()
    below = plan.toString().split("Exchange", 1)[1].split("\n")[1]
    assert "Project" in below and "text#" not in below.rsplit(" AS ", 1)[1] and "regexp_replace" not in plan.toString()
