"""Lists, counts, usage and hygiene of tasks, users and tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import tenancy as O

TASKS = (
    "CAST(o_orderkey AS BIGINT) AS id",
    "CAST(CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey % 25 END AS INT) AS tenant_id",
    "CASE o_orderkey % 7 WHEN 0 THEN 'received' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' WHEN 4 THEN 'retrying' ELSE 'completed' END AS status",
    "CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority",
    "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    "CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END AS INT) AS confidence",
    "md5(CAST(o_custkey AS STRING)) AS md5",
)
USERS = ("CAST(c_custkey AS BIGINT) AS id", "c_name AS name", "CAST(CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_nationkey END AS INT) AS tenant_id", "(c_acctbal > 0) AS is_active", "CAST(c_custkey % 300 AS INT) AS last_login")
TENANTS = ("CAST(n_nationkey AS INT) AS tenant_id", "n_name AS name", "CASE WHEN n_nationkey % 7 = 3 THEN 'suspended' ELSE 'active' END AS status", "CAST(400 + n_nationkey * 20 AS INT) AS max_cases")
CTE = f"tasks AS (SELECT {', '.join(TASKS)} FROM orders), users AS (SELECT {', '.join(USERS)} FROM customer), tenants AS (SELECT {', '.join(TENANTS)} FROM nation)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*TASKS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*USERS)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*TENANTS)


@query("task_list_page", f"WITH {CTE} SELECT id, status, priority, confidence FROM tasks WHERE status = 'completed' AND tenant_id = 4 ORDER BY priority DESC, id LIMIT 20 OFFSET 20")
def task_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.where_all(O.scoped(tasks(spark, sf_dir), 4), F.col("status") == "completed", None)
    return O.listed(rows, "priority", ("priority", "created_at", "status"), page=2).select("id", "status", "priority", "confidence")


@query("task_list_bad_sort", f"WITH {CTE} SELECT id, status FROM tasks ORDER BY created_at, id LIMIT 100")
def task_list_bad_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.listed(tasks(spark, sf_dir), "md5; drop", ("priority", "created_at"), descending=False, page=0, size=5000).select("id", "status")


@query("queue_topk", f"WITH {CTE} SELECT id, priority, status FROM tasks WHERE status IN ('pending', 'received', 'processing') ORDER BY priority DESC, created_at, id LIMIT 50")
def queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.queue(tasks(spark, sf_dir)).select("id", "priority", "status")


@query("status_counts", f"WITH {CTE} SELECT tenant_id, status, count(*) AS n FROM tasks GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.status_counts(tasks(spark, sf_dir), ["tenant_id"])


@query("admin_stats", f"WITH {CTE} SELECT count(*) AS total_tasks, count(*) FILTER (CAST(created_at AS DATE) = DATE '1998-10-03') AS today_tasks, count(*) FILTER (status = 'failed') AS failed_tasks, avg(confidence) AS avg_confidence, (SELECT count(*) FROM customer) AS evidence_total FROM tasks")
def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stats(tasks(spark, sf_dir), users(spark, sf_dir), F.lit("1998-10-03").cast("date"))


@query("admin_stats_scoped", f"WITH {CTE} SELECT count(*) AS total_tasks, count(*) FILTER (CAST(created_at AS DATE) = DATE '1998-10-03') AS today_tasks, count(*) FILTER (status = 'failed') AS failed_tasks, avg(confidence) AS avg_confidence, (SELECT count(*) FROM users WHERE tenant_id = 3) AS evidence_total FROM tasks WHERE tenant_id = 3")
def admin_stats_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stats(O.scoped(tasks(spark, sf_dir), 3), O.scoped(users(spark, sf_dir), 3), F.lit("1998-10-03").cast("date"))


@query("usage_per_tenant", f"""WITH {CTE}, u AS (SELECT tenant_id, count(*) AS users, count(*) FILTER (is_active) AS active_users, max(last_login) AS last_login FROM users GROUP BY 1), t AS (SELECT tenant_id, count(*) AS tasks, count(*) FILTER (status IN ('processing', 'pending', 'received', 'retrying')) AS concurrent FROM tasks GROUP BY 1)
SELECT n.tenant_id, n.name, coalesce(users, 0) AS users, coalesce(active_users, 0) AS active_users, coalesce(tasks, 0) AS tasks, coalesce(concurrent, 0) AS concurrent, last_login FROM tenants n LEFT JOIN u USING (tenant_id) LEFT JOIN t USING (tenant_id)""")
def usage_per_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.usage(tenants(spark, sf_dir), users(spark, sf_dir), tasks(spark, sf_dir))


@query("users_left_join", f"WITH {CTE} SELECT u.id, u.name, n.name AS tenant FROM users u LEFT JOIN tenants n USING (tenant_id)")
def users_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tenants(spark, sf_dir).select("tenant_id", F.col("name").alias("tenant"))
    return users(spark, sf_dir).join(names, "tenant_id", "left").select("id", "name", "tenant")


@query("global_or_own", f"WITH {CTE} SELECT id, tenant_id FROM tasks WHERE tenant_id = 5 OR tenant_id IS NULL")
def global_or_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scoped(tasks(spark, sf_dir), 5, or_global=True).select("id", "tenant_id")


@query("active_filter_in", f"WITH {CTE} SELECT id, status FROM tasks WHERE status IN ('processing', 'pending', 'received', 'retrying') AND confidence IS NOT NULL AND priority <> 3")
def active_filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.where_all(tasks(spark, sf_dir), F.col("status").isin(*O.ACTIVE), F.col("confidence").isNotNull(), F.col("priority") != 3).select("id", "status")


@query("retention_delete", f"WITH {CTE} SELECT id, status FROM tasks WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 90 DAYS)")
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.without_old(tasks(spark, sf_dir), F.lit("1999-01-01").cast("timestamp"), 90).select("id", "status")


@query("dedup_hash_anti", f"""WITH {CTE}, up AS (SELECT CAST(c_custkey AS BIGINT) AS upload, CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 25 END AS INT) AS tenant_id, md5(CAST(c_custkey * 2 AS STRING)) AS md5 FROM customer)
SELECT upload, tenant_id FROM up WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.status <> 'failed' AND t.md5 = up.md5 AND t.tenant_id IS NOT DISTINCT FROM up.tenant_id)""")
def dedup_hash_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS upload", "CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 25 END AS INT) AS tenant_id", "md5(CAST(c_custkey * 2 AS STRING)) AS md5")
    recent = tasks(spark, sf_dir)
    return O.accepted(up, recent).select("upload", "tenant_id")


@query("duplicate_name_semi", "SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10 AND p_name IN (SELECT p_name FROM part WHERE p_size > 40)")
def duplicate_name_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.where("p_size < 10").select(F.col("p_name").alias("name")).join(parts.where("p_size > 40").select(F.col("p_name").alias("name")), "name", "left_semi").distinct()


@query("quota_gate", f"""WITH {CTE}, c AS (SELECT tenant_id, count(*) AS n_cases FROM tasks GROUP BY 1), r AS (SELECT n.*, coalesce(n_cases, 0) AS n_cases FROM tenants n LEFT JOIN c USING (tenant_id))
SELECT tenant_id, name, status, max_cases, n_cases, CASE WHEN status = 'suspended' THEN 'suspended' WHEN n_cases >= max_cases THEN 'quota' ELSE 'none' END AS reason, status <> 'suspended' AND n_cases < max_cases AS allowed FROM r""")
def quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tasks(spark, sf_dir).groupBy("tenant_id").agg(F.count("*").alias("n_cases"))
    return O.quota_gate(tenants(spark, sf_dir), counts)


@query("snapshot_diff", """WITH b AS (SELECT p_partkey AS name, md5(p_name) AS digest FROM part WHERE p_partkey % 5 <> 0), a AS (SELECT p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN md5(concat(p_name, 'x')) ELSE md5(p_name) END AS digest FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'new' WHEN a.digest <> b.digest THEN 'modified' ELSE 'same' END AS status FROM b FULL JOIN a ON a.name = b.name""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    before = parts.where("p_partkey % 5 <> 0").selectExpr("p_partkey AS name", "md5(p_name) AS digest")
    after = parts.where("p_partkey % 7 <> 0").selectExpr("p_partkey AS name", "CASE WHEN p_size % 4 = 0 THEN md5(concat(p_name, 'x')) ELSE md5(p_name) END AS digest")
    return O.snapshot_diff(before, after)


STEPS = ("CAST(l_orderkey AS BIGINT) AS case_id", "CAST(((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS BIGINT) AS seq", "concat('step', CAST(l_linenumber AS STRING)) AS step", "CASE l_partkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE 'pending' END AS status")


@query("progress_steps", f"WITH s AS (SELECT {', '.join(STEPS)} FROM lineitem) SELECT case_id, count(*) AS total_steps, count(*) FILTER (status = 'completed') AS completed_steps, arg_min(step, seq) FILTER (status = 'processing') AS current_step FROM s GROUP BY 1")
def progress_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.progress(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*STEPS))


@query("storage_accounting", "SELECT CAST(l_suppkey % 25 AS INT) AS tenant_id, CAST(greatest(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_partkey * 1000 AS BIGINT)), 0) AS BIGINT) / 1048576 AS storage_mb FROM lineitem GROUP BY 1")
def storage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_suppkey % 25 AS INT) AS tenant_id", "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign", "CAST(l_partkey * 1000 AS BIGINT) AS bytes")
    return O.storage_used(changes)


@query("nest_children", f"WITH {CTE}, l AS (SELECT CAST(l_orderkey AS BIGINT) AS id, count(*) AS n_files, CAST(sum(l_partkey) AS BIGINT) AS part_sum, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1) SELECT t.id, t.status, coalesce(n_files, 0) AS n_files, coalesce(part_sum, 0) AS part_sum, first_line FROM tasks t LEFT JOIN l USING (id)")
def nest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("files"))
    rows = tasks(spark, sf_dir).join(files, "id", "left")
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["l_partkey"])
    return rows.select("id", "status", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n_files"), F.coalesce(total, F.lit(0)).alias("part_sum"), F.array_min(F.col("files.l_linenumber")).alias("first_line"))
