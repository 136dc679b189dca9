"""Templates over time: versions with validity, and lookups as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("description", "rules", "code", "reference")
KEY = ("tenant_id", "name")


def versions(changes: DataFrame) -> DataFrame:
    """tenant_id, name, version (from 1), valid_from, valid_to (null: still), FIELDS and is_current of each version that was there.

    changes: tenant_id (null: for all), name, ts, seq (order within one time), action (create, update,
    clear, delete, restore) and FIELDS. An update leaves a null field as it is, clear takes the reference
    away, delete ends a template, restore brings back what was deleted. A create of a template that is there
    updates it; anything but a create or a restore of one that is not there is passed over, as is a restore of
    what never was. All is by template: one exchange.
    """
    w = Window.partitionBy(*KEY).orderBy("ts", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = changes.where("name is not null and ts is not null")
    # there or not follows from the last create, restore or delete; a restore needs a create somewhere before it
    created = F.coalesce(F.max(F.when(F.col("action") == "create", 1)).over(before), F.lit(0)) == 1
    rows = rows.withColumn("_can", (F.col("action") != "restore") | created)
    turns = F.when(F.col("action") == "create", True).when((F.col("action") == "restore") & F.col("_can"), True).when(F.col("action") == "delete", False)
    rows = rows.withColumn("_turn", turns).withColumns({"_was": F.coalesce(F.last("_turn", ignorenulls=True).over(before), F.lit(False)), "_is": F.coalesce(F.last("_turn", ignorenulls=True).over(w), F.lit(False))})
    counts = F.when(F.col("action") == "create", True).when(F.col("action") == "restore", F.col("_can") & ~F.col("_was")).otherwise(F.col("_was"))
    rows = rows.where(counts)
    # a create of what is not there starts anew: fields come from changes since then
    rows = rows.withColumn("_life", F.sum(F.when((F.col("action") == "create") & ~F.col("_was"), 1).otherwise(0)).over(w))
    life = Window.partitionBy(*KEY, "_life").orderBy("ts", "seq")

    def field(name: str) -> Column:
        said = F.when(F.col("action").isin("create", "update"), F.col(name))
        if name != "reference":
            return F.last(said, ignorenulls=True).over(life)
        marked = F.when(F.col("action") == "clear", F.struct(F.lit(None).cast("string").alias("v"))).when(said.isNotNull(), F.struct(said.cast("string").alias("v")))
        return F.last(marked, ignorenulls=True).over(life)["v"]

    rows = rows.withColumns({f"_{f}": field(f) for f in FIELDS} | {"valid_to": F.lead("ts").over(w)}).where("_is")
    number = F.row_number().over(w)
    return rows.select(*KEY, number.alias("version"), F.col("ts").alias("valid_from"), "valid_to", *[F.col(f"_{f}").alias(f) for f in FIELDS], F.col("valid_to").isNull().alias("is_current"))


def as_of(known: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, tenant_id, name, ts) with the version that the tenant found at that time: its own, else the one for all; null without one.

    Versions and questions of a template meet in one sort by time, so no question is compared with every
    version: each takes the last version that began by then, if it had not ended.
    """
    kept = ("version", "valid_from", *FIELDS)
    version = known.select("tenant_id", "name", F.col("valid_from").alias("_at"), F.lit(0).alias("_asks"), F.struct("valid_to", *kept).alias("_v"), F.lit(None).cast(dict(asked.dtypes)["id"]).alias("id"), F.lit(None).cast(dict(asked.dtypes)["tenant_id"]).alias("_for"))
    own = asked.select("tenant_id", "name", F.col("ts").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(version.schema["_v"].dataType).alias("_v"), "id", F.col("tenant_id").alias("_for"))
    for_all = own.where("tenant_id is not null").withColumn("tenant_id", F.lit(None).cast(dict(known.dtypes)["tenant_id"]))
    w = Window.partitionBy("tenant_id", "name").orderBy("_at", "_asks", "_v.version").rowsBetween(Window.unboundedPreceding, 0)
    met = version.unionByName(own).unionByName(for_all).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_asks = 1")
    fits = F.col("_v").isNotNull() & (F.col("_v.valid_to").isNull() | (F.col("_v.valid_to") > F.col("_at")))
    best = F.min_by(F.when(fits, F.struct("tenant_id", *[F.col(f"_v.{c}").alias(c) for c in kept])), F.when(fits, F.when(F.col("tenant_id").isNull(), 1).otherwise(0)))
    found = met.groupBy("id").agg(best.alias("_b"))
    return found.select("id", F.col("_b.tenant_id").alias("tenant_id"), *[F.col(f"_b.{c}").alias(c) for c in kept])
