"""Where results go: structured JSON, partitioned bundles, upserts, quarantine, and batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def as_json(df: DataFrame, key: str, columns: Sequence[str], name: str = "document", most: int | None = None) -> DataFrame:
    """key and a JSON document of columns; null fields are left out, longer documents are cut at most characters."""
    body: Column = F.to_json(F.struct(*columns))
    return df.select(key, (F.substring(body, 1, most) if most else body).alias(name))


def nested_sections(tree: DataFrame, paragraphs: DataFrame, levels: int = 5) -> DataFrame:
    """One JSON document per doc_id: its sections (idx, title, level, parent, depth) nested to levels, with their paragraphs.

    Sections are folded from the deepest level up, one aggregation a level, so no document passes through Python.
    """
    texts = paragraphs.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("p"))
    rows = tree.join(texts.select("doc_id", F.col("section").alias("idx"), F.col("p.text").alias("paragraphs")), ["doc_id", "idx"], "left")
    below = None
    for depth in range(levels, 0, -1):
        here = rows.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("subsections", F.array().cast("array<string>"))
        else:
            here = here.join(below, (here["doc_id"] == below["_d"]) & (here["idx"] == below["_p"]), "left").drop("_d", "_p")
        body = F.to_json(F.struct("level", "title", F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs")))
        inner = F.concat(F.lit('"subsections":['), F.coalesce(F.array_join("subsections", ","), F.lit("")), F.lit("]}"))
        made = here.withColumn("_b", body).withColumn("_j", F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.lit(","), inner))
        below = made.groupBy(F.col("doc_id").alias("_d"), F.col("parent").alias("_p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "_j"))), lambda x: x["_j"]).alias("subsections"))
    return below.where("_p is null").select(F.col("_d").alias("doc_id"), F.concat(F.lit("["), F.array_join("subsections", ","), F.lit("]")).alias("sections"))


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """current with changes by keys: of several changes the last by order; new keys are added. Columns are those of current."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return current.join(last, list(keys), "left_anti").unionByName(last.select(*current.columns))


def without_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """parents and children without the parents whose key is in gone."""
    return parents.join(gone, key, "left_anti"), children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def bundled(df: DataFrame, path: str, by: Sequence[str] = ("case_id", "doc_type"), form: str = "json") -> None:
    """Writes rows in folders by case and kind."""
    df.write.partitionBy(*by).format(form).mode("overwrite").save(path)


def split_valid(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error_code, and the others with the name that they are put aside under."""
    bad = files.where(F.col("error_code").isNotNull()).withColumn("quarantined_as", F.concat_ws("_", "error_code", "name"))
    return files.where(F.col("error_code").isNull()), bad


def to_batches(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Sends every micro-batch once its input is known; a failed batch is tried again from the checkpoint."""
    writer = stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
