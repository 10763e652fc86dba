"""Queries over metric samples, GPU snapshots and heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import telemetry
from runledger.plans.registry import query
from runledger.plans.tables import Tables
from runledger.sources.documents import gpu_rows

INTERVAL_MS, MISSES = 3_456_000, 25  # a day of silence, so that both outcomes occur
EXPIRY_MS = INTERVAL_MS * MISSES

AVERAGE_SQL = """
    s AS (SELECT task, value, row_number() OVER (PARTITION BY task ORDER BY ts_ms, id) - 1 AS n FROM samples),
    fold AS (SELECT task, n, CASE WHEN value IS NULL THEN -1.0::DOUBLE ELSE value END AS avg_value FROM s WHERE n = 0
             UNION ALL SELECT s.task, s.n, CASE WHEN s.value IS NULL THEN f.avg_value ELSE (f.avg_value * s.n + s.value) / (s.n + 1) END
             FROM fold f JOIN s ON s.task = f.task AND s.n = f.n + 1)"""


@query("G10_running_maximum", "SELECT task, greatest(coalesce(max(value), -1), -1) AS max_value FROM samples GROUP BY task", ("samples",))
def running_maximum(t: Tables):
    return telemetry.running_maximum(t.samples)


@query(
    "G11_running_average",
    f"{AVERAGE_SQL} SELECT task, max(n) + 1 AS refreshes, round(max_by(avg_value, n), 6) AS avg_value FROM fold GROUP BY task",
    ("samples",), recursive=True,
)
def running_average(t: Tables):
    out = telemetry.running_average(t.samples, t.task_hot)
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query(
    "G12_gpu_metrics",
    """
    g AS (SELECT s_suppkey AS snap, unnest([s_suppkey % 101, (s_suppkey * 3) % 101])::DOUBLE AS util,
                 unnest([(s_suppkey % 7) / (s_suppkey % 7 + 8 + s_suppkey % 5), (s_suppkey % 3) / (s_suppkey % 3 + 4 + s_suppkey % 9)]) * 100 AS fb FROM supplier)
    SELECT snap, max(util) AS max_utilization, avg(util) AS avg_utilization, round(max(fb), 6) AS max_fb_percent, round(avg(fb), 6) AS avg_fb_percent,
           CAST(NULL AS DOUBLE) AS max_bar1_percent, CAST(NULL AS DOUBLE) AS avg_bar1_percent FROM g GROUP BY snap""",
)
def gpu_metrics(t: Tables):
    out = telemetry.gpu_metrics(gpu_rows(t.gpu_xml, "xml", "snap"), "snap")
    return out.select(
        "snap", F.col("max_utilization").cast("double").alias("max_utilization"), "avg_utilization",
        *(F.round(c, 6).alias(c) for c in out.columns if c.endswith("percent")),
    )


@query(
    "G13_latest_metrics",
    "SELECT task, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts_ms DESC, id DESC) AS r FROM samples) s WHERE r = 1",
    ("samples",),
)
def latest_metrics(t: Tables):
    return telemetry.latest(t.samples)


@query(
    "J07_as_of_metrics",
    """
    f AS (SELECT task, id, ts_ms FROM pings WHERE kind = 'result'),
    g AS (SELECT task, ts_ms, max(id) AS mid, max_by(value, id) AS value FROM samples WHERE id % 2 = 0 GROUP BY task, ts_ms)
    SELECT f.task, f.id, f.ts_ms, g.value FROM f ASOF LEFT JOIN g ON f.task = g.task AND f.ts_ms >= g.ts_ms""",
    ("samples", "pings"),
)
def as_of_metrics(t: Tables):
    finishes = t.pings.where("kind = 'result'").select("task", "id", "ts_ms")
    stored = t.samples.where("id % 2 = 0")
    return telemetry.as_of_metrics(finishes, stored, "value", t.task_hot)


GAP_SQL = "SELECT *, lag(ts_ms) OVER (PARTITION BY task ORDER BY ts_ms, id) AS previous_ms FROM pings"


@query(
    "W07_heartbeat_gap",
    f"""SELECT task, id, ts_ms, kind, previous_ms, ts_ms - previous_ms AS gap_ms, coalesce(ts_ms - previous_ms > {EXPIRY_MS}, false) AS dead
    FROM ({GAP_SQL}) g""",
    ("pings",),
)
def heartbeat_gap(t: Tables):
    return telemetry.heartbeat_gaps(t.pings, INTERVAL_MS, MISSES, t.task_hot)


@query(
    "W09_failure_runs",
    """
    i AS (SELECT *, count(value) OVER (PARTITION BY task ORDER BY ts_ms, id) AS island FROM samples)
    SELECT task, id, ts_ms, value, count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY task, island ORDER BY ts_ms, id) AS run,
           count(*) FILTER (WHERE value IS NULL) OVER (PARTITION BY task, island ORDER BY ts_ms, id) > 1 AS tripped FROM i""",
    ("samples",),
)
def failure_runs(t: Tables):
    return telemetry.failure_runs(t.samples, 1, t.task_hot)


@query(
    "W05_changed_snapshot",
    """SELECT task, id, ts_ms, kind, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY task ORDER BY ts_ms, id) AS changed FROM pings""",
    ("pings",),
)
def changed_snapshot(t: Tables):
    return telemetry.changed_snapshots(t.pings, ["kind"], t.task_hot)


@query(
    "W06_every_twentieth",
    """SELECT task, id, ts_ms, poll FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts_ms, id) AS poll FROM pings) p WHERE poll % 20 = 1""",
    ("pings",),
)
def every_twentieth(t: Tables):
    return telemetry.every_nth(t.pings, 20, t.task_hot).select("task", "id", "ts_ms", "poll")


@query(
    "W06_first_per_interval",
    """SELECT task, ts_ms // 43200000 AS interval, ts_ms, id FROM (SELECT *, row_number() OVER (PARTITION BY task, ts_ms // 43200000 ORDER BY ts_ms, id) AS r FROM pings) p WHERE r = 1""",
    ("pings",),
)
def first_per_interval(t: Tables):
    return telemetry.first_per_interval(t.pings, 43_200_000)
