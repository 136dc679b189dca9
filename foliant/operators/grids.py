"""Tables as grids in long form: cells that reach over empty neighbours, and tables as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

TABLE = ("doc_id", "page")
#: Characters of a cell that are shown (fixed value).
SHOWN = 200


def grids(cells: DataFrame, part: tuple[str, ...] = TABLE) -> DataFrame:
    """part and cells, one row a table: row, col, rowspan, colspan and text of what it shows in order; every place of its grid lies in exactly one.

    cells: part, row, col (from 0) and text, one row a place at most; places without a row or with a blank
    text are empty. A cell reaches right over empty places to the next one with a text, then down over rows
    whose places up to its end are all empty. Cells of those rows lie to the right of it, so no two overlap.
    Empty places that no cell reaches, at the start of a row, are cells of their own. A table is gathered once,
    and the rest is functions of its array: a task sorts its rows once and holds one table.
    """
    place = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")
    size = lambda n: (F.max(n) + 1).cast("int")
    full = F.collect_list(F.when(F.col("text") != "", place))
    tables = cells.withColumn("text", stripped(F.col("text"))).groupBy(*part).agg(size("row").alias("_rows"), size("col").alias("_cols"), F.sort_array(full).alias("_texts"))

    # the first text of each row that has one, and how far each text reaches to the right
    first = F.filter("_texts", lambda x, i: ~F.get("_texts", i - 1)["row"].eqNullSafe(x["row"]))
    right = lambda x, i: F.when(F.get("_texts", i + 1)["row"] == x["row"], F.get("_texts", i + 1)["col"]).otherwise(F.col("_cols"))
    wide = F.transform("_texts", lambda x, i: F.struct(x["row"].alias("row"), x["col"].alias("col"), right(x, i).alias("end"), x["text"].alias("text")))
    tables = tables.select(*part, "_rows", "_cols", first.alias("_first"), wide.alias("_wide"))

    # rows below stay in reach up to the first with a text left of the cell's end
    below = lambda x: F.coalesce(F.get(F.filter("_first", lambda f: (f["row"] > x["row"]) & (f["col"] < x["end"])), F.lit(0))["row"], F.col("_rows"))
    shown = F.transform("_wide", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), (below(x) - x["row"]).alias("rowspan"), (x["end"] - x["col"]).alias("colspan"), x["text"].alias("text")))
    tables = tables.select(*part, "_rows", "_cols", "_first", shown.alias("_shown"))

    # places at the start of rows, before the first text, that no cell from above covers
    start = lambda r: F.coalesce(F.get(F.filter("_first", lambda f: f["row"] == r), F.lit(0))["col"], F.col("_cols"))
    above = lambda r: F.filter("_shown", lambda s: (s["row"] < r) & (s["row"] + s["rowspan"] > r))
    rows = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), lambda r: F.struct(r.alias("row"), F.slice(F.sequence(F.lit(0), F.col("_cols") - 1), 1, start(r)).alias("cols"), above(r).alias("above")))
    open_ = lambda x: F.filter(x["cols"], lambda c: ~F.exists(x["above"], lambda s: (s["col"] <= c) & (s["col"] + s["colspan"] > c)))
    one = F.lit(1).alias
    free = F.flatten(F.transform(rows, lambda x: F.transform(open_(x), lambda c: F.struct(x["row"].alias("row"), c.alias("col"), one("rowspan"), one("colspan"), F.lit("").alias("text")))))
    return tables.select(*part, F.sort_array(F.concat("_shown", free)).alias("cells"))


def spans(cells: DataFrame, part: tuple[str, ...] = TABLE) -> DataFrame:
    """part, row, col, rowspan, colspan and text of the cells that a table shows: grids() in long form."""
    return grids(cells, part).select(*part, F.inline("cells"))


def escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def html(shown: DataFrame, part: tuple[str, ...] = TABLE, css: str = "table", most: int = SHOWN) -> DataFrame:
    """part and html: a table of spans() cells, its first row as the head if it has more than one; longer texts end in dots."""
    cells = F.sort_array(F.collect_list(F.struct("row", "col", "rowspan", "colspan", "text")))
    return html_of(shown.groupBy(*part).agg(cells.alias("cells")), part, css, most)


def html_of(tables: DataFrame, part: tuple[str, ...] = TABLE, css: str = "table", most: int = SHOWN) -> DataFrame:
    """html() of the rows of grids(), a table each; none is gathered again."""
    text = lambda c: F.concat(escaped(F.substring(c["text"], 1, most)), F.when(F.length(c["text"]) > most, "...").otherwise(""))
    span = lambda c, n: F.when(c[n] > 1, F.concat(F.lit(f' {n}="'), c[n].cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("<td"), span(c, "rowspan"), span(c, "colspan"), F.lit(">"), text(c), F.lit("</td>"))
    last = F.array_max(F.transform("cells", lambda c: c["row"] + c["rowspan"] - 1))
    tables = tables.select(*part, last.alias("_last"), F.transform("cells", lambda c: F.struct(c["row"].alias("row"), cell(c).alias("cell"))).alias("_cells"))
    of_row = lambda r: F.concat_ws("\n", F.lit("<tr>"), F.transform(F.filter("_cells", lambda c: c["row"] == r), lambda c: c["cell"]), F.lit("</tr>"))
    rows = F.transform(F.sequence(F.lit(0), F.col("_last")), of_row)
    many = F.col("_last") > 0
    head = F.when(many, F.concat_ws("\n", F.lit("<thead>"), F.col("_rows")[0], F.lit("</thead>")))
    body = F.when(many, F.slice("_rows", 2, F.size("_rows") - 1)).otherwise(F.col("_rows"))
    lines = F.concat_ws("\n", F.lit(f'<table class="{css}">'), head, F.lit("<tbody>"), body, F.lit("</tbody>"), F.lit("</table>"))
    return tables.withColumn("_rows", rows).select(*part, lines.alias("html"))
