"""Queries over hosts, ranks, dependency graphs and the history store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import graph, placement, upkeep
from runledger.plans.registry import query
from runledger.plans.tables import Tables

HOSTS_SQL = "p AS (SELECT k, host, CAST(count(*) AS INT) AS processes FROM tasks WHERE role <> 'ps' GROUP BY k, host)"
PLAN_SQL = f"""{HOSTS_SQL},
    s AS (SELECT k, host, processes, CAST(unnest(range(processes)) AS INT) AS local_rank FROM p),
    pl AS (SELECT k, host, CAST(row_number() OVER (PARTITION BY k ORDER BY host, local_rank) - 1 AS INT) AS rank, local_rank,
              CAST(row_number() OVER (PARTITION BY k, local_rank ORDER BY host) - 1 AS INT) AS cross_rank,
              CAST(count(*) OVER (PARTITION BY k) AS INT) AS size, processes AS local_size,
              CAST(count(*) OVER (PARTITION BY k, local_rank) AS INT) AS cross_size FROM s)"""


def processes(t: Tables) -> DataFrame:
    return placement.host_processes(t.tasks, driver_role="ps")


@query(
    "G08_cluster_members",
    "SELECT k, role, idx AS pos, concat(host, ':', greatest(k % 50 - 1, 0)) AS host_port FROM tasks WHERE host <> 'host3'",
    ("tasks",),
)
def cluster_members(t: Tables):
    rows = t.tasks.withColumn("host", F.when(F.col("host") != "host3", F.col("host")))
    return placement.cluster_members(rows.withColumn("port", F.col("k") % 50 - 1))


@query(
    "G09_host_processes",
    f"{HOSTS_SQL} SELECT k, string_agg(concat(host, ':', processes), ',' ORDER BY concat(host, ':', processes)) AS hosts FROM p GROUP BY k",
    ("tasks",),
)
def host_processes(t: Tables):
    return placement.host_list(processes(t))


@query(
    "G22_counts_by_host",
    "SELECT host, count(*) AS results FROM tasks WHERE exit_code IS NOT NULL GROUP BY host",
    ("tasks",),
)
def counts_by_host(t: Tables):
    return t.tasks.where(F.col("exit_code").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("results"))


@query("W03_rank_plan", f"{PLAN_SQL} SELECT * FROM pl", ("tasks",))
def rank_plan(t: Tables):
    return placement.rank_plan(processes(t), t.app_hot)


LOCAL_SQL = """ls AS (SELECT k, role, idx, host, CAST(row_number() OVER (PARTITION BY k, host ORDER BY idx, role) - 1 AS INT) AS local_seq
              FROM tasks WHERE role <> 'ps')"""


@query("W04_local_sequence", f"{LOCAL_SQL} SELECT * FROM ls", ("tasks",))
def local_sequence(t: Tables):
    rows = t.tasks.select("k", "role", "idx", "host")
    return placement.local_sequence(rows, t.app_hot, driver_role="ps")


@query(
    "J05_slot_assignment",
    f"""{PLAN_SQL}, {LOCAL_SQL}
    SELECT ls.k, role, idx, ls.host, local_rank, rank, cross_rank, size, local_size, cross_size
    FROM ls JOIN pl ON ls.k = pl.k AND ls.host = pl.host AND ls.local_seq = pl.local_rank""",
    ("tasks",),
)
def slot_assignment(t: Tables):
    workers = t.tasks.where(F.col("role") != "ps")
    return placement.assign_slots(workers, placement.rank_plan(processes(t), t.app_hot), t.app_hot)


# Fixed: which roles wait for which; every seventh application also gets an edge back.
GRAPH_SQL = """
    n AS (SELECT DISTINCT k AS app, role FROM tasks),
    e AS (SELECT n.app, n.role, v.dep AS depends_on FROM n
          JOIN (VALUES ('worker', 'ps', 1), ('evaluator', 'worker', 1), ('ps', 'evaluator', 7), ('ps', 'gone', 1)) v(role, dep, every)
            ON v.role = n.role AND n.app % v.every = 0
          WHERE v.dep IN (SELECT role FROM n m WHERE m.app = n.app)),
    walk AS (SELECT app, role AS start, depends_on AS here, 1 AS depth FROM e
             UNION SELECT w.app, w.start, e.depends_on, depth + 1 FROM walk w JOIN e ON e.app = w.app AND e.role = w.here WHERE depth < 4)
    SELECT DISTINCT n.app, n.app NOT IN (SELECT app FROM walk WHERE start = here) AS acyclic FROM n"""


@query("D02_acyclic_app_graphs", GRAPH_SQL, ("tasks",), recursive=True)
def acyclic_app_graphs(t: Tables):
    nodes = t.tasks.select(F.col("k").alias("app"), "role").distinct()
    edge = lambda role, dep, every: F.when(
        (F.col("role") == role) & (F.col("app") % every == 0), F.lit(dep)
    )
    waits = F.array(edge("worker", "ps", 1), edge("evaluator", "worker", 1), edge("ps", "evaluator", 7), edge("ps", "gone", 1))
    edges = nodes.select("app", "role", F.explode(F.array_compact(waits)).alias("depends_on"))
    return graph.acyclic(nodes, edges)


@query(
    "D02_acyclic_region_graphs",
    """
    walk AS (SELECT app, role AS start, depends_on AS here, 1 AS depth FROM edges
             UNION SELECT w.app, w.start, e.depends_on, depth + 1 FROM walk w JOIN edges e ON e.app = w.app AND e.role = w.here WHERE depth < 25)
    SELECT DISTINCT app, app NOT IN (SELECT app FROM walk WHERE start = here) AS acyclic FROM edges""",
    ("edges",), recursive=True,
)
def acyclic_region_graphs(t: Tables):
    nodes = t.raw("nation").select(F.col("n_regionkey").alias("app"), F.col("n_nationkey").alias("role"))
    return graph.acyclic(nodes, t.edges)


# --- upkeep ---------------------------------------------------------------------------------

ZONE = "America/Los_Angeles"
PLACED_SQL = f"""
    d AS (SELECT k, name, (epoch_ms(CAST(split_part(name, '-', 3) AS BIGINT)) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS done
          FROM file_names WHERE ends_with(name, 'jhist')),
    pt AS (SELECT k, name, strftime(done, '%Y') AS year, strftime(done, '%m') AS month, strftime(done, '%d') AS day FROM d)"""


@query("K03_store_partition", f"{PLACED_SQL} SELECT * FROM pt", ("file_names",))
def store_partition(t: Tables):
    return upkeep.store_partition(t.file_names, ZONE)


@query(
    "K04_expired_partitions",
    f"""{PLACED_SQL},
    x AS (SELECT DISTINCT CASE WHEN year = '1997' THEN 'y1997' ELSE year END AS year, month, day FROM pt)
    SELECT year, month, day, CASE WHEN make_date(CAST(year AS INT), 12, 31) < DATE '2000-05-17' THEN 'year'
         WHEN last_day(make_date(CAST(year AS INT), CAST(month AS INT), 1)) < DATE '2000-05-17' THEN 'month' ELSE 'day' END AS level
    FROM x WHERE year <> 'y1997' AND make_date(CAST(year AS INT), CAST(month AS INT), CAST(day AS INT)) < DATE '2000-05-17'""",
    ("file_names",),
)
def expired_partitions(t: Tables):
    odd = F.when(F.col("year") == "1997", "y1997").otherwise(F.col("year"))
    placed = upkeep.store_partition(t.file_names, ZONE)
    parts = placed.select("year", "month", "day").distinct()
    parts = parts.withColumn("year", odd)
    return upkeep.expired_partitions(parts, F.lit("2000-05-17").cast("date"))


@query(
    "K05_expired_landing",
    f"""SELECT k, name FROM (SELECT f.k, name, (epoch_ms(started_ms + f.k * 1000) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS m
        FROM file_names f JOIN apps USING (k)) x WHERE CAST(m AS DATE) < DATE '1999-03-01'""",
    ("file_names",),
)
def expired_landing(t: Tables):
    dirs = t.file_names.join(t.apps.select("k", (F.col("started_ms") + F.col("k") * 1000).alias("modified_ms")), "k")
    return upkeep.expired_landing(dirs, "modified_ms", F.lit("1999-03-01").cast("date"), ZONE).select("k", "name")


@query(
    "K06_finalise_killed",
    """SELECT k, app_id, started_ms, usr, CASE WHEN completed_ms = -1 AND k % 3 = 0 THEN 1767225600000 ELSE completed_ms END AS completed_ms,
         CASE WHEN completed_ms = -1 AND k % 3 = 0 THEN 'KILLED' ELSE status END AS status FROM apps""",
    ("apps",),
)
def finalise_killed(t: Tables):
    killed = t.apps.where("k % 3 = 0").select("app_id")
    return upkeep.finalise_killed(t.apps, killed, 1_767_225_600_000)


@query(
    "J02_killed_landing",
    "SELECT k, app_id FROM apps WHERE app_id IN (SELECT concat('application_', o_custkey, '_', o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT')",
    ("apps",),
)
def killed_landing(t: Tables):
    return upkeep.killed_landing(t.apps.select("k", "app_id"), _killed(t))


@query(
    "J02_killed_landing_contains",
    """
    i AS (SELECT DISTINCT concat(o_custkey, '_', o_orderkey // 10) AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
    p AS (SELECT DISTINCT k, app_id, substr(app_id, s, n) AS piece FROM apps, (SELECT unnest(range(1, 64)) AS s), (SELECT DISTINCT length(id) AS n FROM i)
          WHERE s + n - 1 <= length(app_id))
    SELECT DISTINCT k, app_id FROM p WHERE piece IN (SELECT id FROM i)""",
    ("apps",),
)
def killed_landing_contains(t: Tables):
    orders = t.raw("orders").where("o_orderpriority = '1-URGENT'")
    killed = orders.select(F.concat_ws("_", F.col("o_custkey").cast("string"), F.expr("o_orderkey div 10").cast("string")).alias("app_id"))
    return upkeep.killed_landing(t.apps.select("k", "app_id"), killed, mode="contains")


def _killed(t: Tables) -> DataFrame:
    orders = t.raw("orders").where("o_orderpriority = '1-URGENT'")
    return orders.select(
        F.concat_ws("_", F.lit("application"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("app_id")
    )
