"""Tenant-scoped reads: lists, counts, usage, quotas, duplicates, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a task that use a slot, and states that end it.
ACTIVE = ("processing", "pending", "received", "retrying")
TERMINAL = ("completed", "failed", "cancelled")
PAGE_LIMIT = 100


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition that is given."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def scoped(df: DataFrame, tenant: int | None, or_global: bool = False) -> DataFrame:
    """Rows of a tenant, with rows of none if or_global; all rows without a tenant."""
    if tenant is None:
        return df
    own = F.col("tenant_id") == tenant
    return df.where(own | F.col("tenant_id").isNull() if or_global else own)


def listed(df: DataFrame, sort: str, allowed: Sequence[str], descending: bool = True, page: int = 1, size: int = 20, tie: str = "id", default: str = "created_at") -> DataFrame:
    """A page (from 1) of rows by a column that must be allowed, else by default; ties by id. Sizes are 1 to 100."""
    column = sort if sort in allowed else default
    size = max(1, min(PAGE_LIMIT, size))
    order = [F.desc(column) if descending else F.asc(column), F.asc(tie)]
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def queue(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """The next tasks: those that wait, the highest priority first, then the oldest."""
    return tasks.where(F.col("status").isin("pending", "received", "processing")).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(limit)


def status_counts(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tasks.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def stats(tasks: DataFrame, cases: DataFrame, today: Column) -> DataFrame:
    """One row: tasks, of today, failed, mean confidence, and cases, by one pass over each table."""
    a = tasks.agg(F.count("*").alias("total_tasks"), F.count_if(F.to_date("created_at") == today).alias("today_tasks"), F.count_if(F.col("status") == "failed").alias("failed_tasks"), F.avg("confidence").alias("avg_confidence"))
    return a.crossJoin(cases.agg(F.count("*").alias("evidence_total")))


def usage(tenants: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per tenant: users, active users, tasks, tasks that use a slot, last login; 0 where there are none."""
    u = users.groupBy("tenant_id").agg(F.count("*").alias("users"), F.count_if("is_active").alias("active_users"), F.max("last_login").alias("last_login"))
    t = tasks.groupBy("tenant_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status").isin(*ACTIVE)).alias("concurrent"))
    joined = tenants.join(u, "tenant_id", "left").join(t, "tenant_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("users", "active_users", "tasks", "concurrent")}
    return joined.select("tenant_id", "name", *[v.alias(k) for k, v in zero.items()], "last_login")


def quota_gate(tenants: DataFrame, counts: DataFrame) -> DataFrame:
    """tenants (tenant_id, status, max_cases) with n_cases, allowed and reason: suspended, quota or none."""
    rows = tenants.join(counts, "tenant_id", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
    reason = F.when(F.col("status") == "suspended", "suspended").when(F.col("n_cases") >= F.col("max_cases"), "quota").otherwise("none")
    return rows.withColumn("reason", reason).withColumn("allowed", reason == "none")


def accepted(uploads: DataFrame, tasks: DataFrame) -> DataFrame:
    """Uploads whose content no task of the tenant has but failed ones; a null tenant is a tenant of its own."""
    known = tasks.where("status <> 'failed'").select(F.coalesce("tenant_id", F.lit(-1)).alias("_t"), F.col("md5").alias("_m")).distinct()
    return uploads.join(known, (F.coalesce("tenant_id", F.lit(-1)) == F.col("_t")) & (F.col("md5") == F.col("_m")), "left_anti")


def without_old(tasks: DataFrame, now: Column, days: int) -> DataFrame:
    """Tasks but those that ended and are older than days."""
    return tasks.where(~(F.col("status").isin(*TERMINAL) & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS"))))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and status (missing, new, modified, same) of files (name, digest) in either snapshot."""
    b, a = before.select("name", F.col("digest").alias("_b")), after.select("name", F.col("digest").alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.col("_a") != F.col("_b"), "modified").otherwise("same")
    return b.join(a, "name", "full_outer").select("name", status.alias("status"))


def progress(steps: DataFrame) -> DataFrame:
    """Per case: steps, completed steps, and the first step that is processing."""
    return steps.groupBy("case_id").agg(F.count("*").alias("total_steps"), F.count_if(F.col("status") == "completed").alias("completed_steps"), F.min_by("step", F.when(F.col("status") == "processing", F.col("seq"))).alias("current_step"))


def storage_used(changes: DataFrame) -> DataFrame:
    """Megabytes by tenant from uploads and deletions (sign, bytes), never below 0."""
    return changes.groupBy("tenant_id").agg(F.greatest(F.sum(F.col("sign") * F.col("bytes")), F.lit(0)).alias("_b")).select("tenant_id", (F.col("_b") / 1048576).alias("storage_mb"))
