"""Queries in which every application follows its own settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import rules, tasks
from runledger.plans.registry import query
from runledger.plans.tables import Tables

RULED_SQL = """
    rt AS (SELECT t.*, NOT list_contains(r.off_roles, t.role) AS tracked, list_contains(r.stop_roles, t.role) AS stops, r.strict
           FROM tasks t JOIN app_rules r USING (k))"""
RULED = ("tasks", "app_rules")


def ruled(t: Tables) -> DataFrame:
    return rules.with_rules(t.tasks, t.job_settings, hot=t.hot_apps)


COUNTERS_SQL = f"""{RULED_SQL},
    c AS (SELECT k, count(*) AS total, count(*) FILTER (tracked) AS tracked, count(exit_code) AS completed,
                 count(exit_code) FILTER (tracked) AS completed_tracked, count(*) FILTER (exit_code NOT IN (0, -105)) AS failed FROM rt GROUP BY k)"""


@query("G02_counters_by_settings", f"{COUNTERS_SQL} SELECT * FROM c", RULED)
def counters(t: Tables):
    return tasks.counters(ruled(t), F.col("tracked"))


@query(
    "G03_progress_by_settings",
    f"{COUNTERS_SQL} SELECT k, CASE WHEN tracked = 0 THEN 0.0::DOUBLE ELSE completed_tracked / tracked END AS progress FROM c", RULED,
)
def progress(t: Tables):
    return tasks.progress(tasks.counters(ruled(t), F.col("tracked"))).select("k", "progress")


@query(
    "G04_final_status_by_settings",
    f"""{RULED_SQL},
    s AS (SELECT k, bool_or(strict) AS strict, count(*) FILTER (tracked) AS n, count(*) FILTER (tracked AND exit_code IS NULL) AS open_n,
              min(concat(role, ':', lpad(CAST(idx AS VARCHAR), 9, '0'))) FILTER (tracked AND exit_code IS NULL) AS first_open,
              count(*) FILTER (tracked AND exit_code <> 0) AS failures FROM rt GROUP BY k),
    b AS (SELECT *, failures > 0 AND (strict OR failures >= n) AS broken FROM s)
    SELECT k, CASE WHEN open_n > 0 OR broken THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
           CASE WHEN open_n > 0 THEN concat('Job ', split_part(first_open, ':', 1), ':', CAST(split_part(first_open, ':', 2) AS INT), ' hasn''t finished yet.')
                WHEN broken THEN concat('At least one job task exited with non-zero status, failedCnt=', failures)
                WHEN failures > 0 THEN concat('Training completed with some worker jobs failure, failedCnt=', failures) END AS message
    FROM b""",
    RULED,
)
def final_status(t: Tables):
    return tasks.final_status(ruled(t), F.col("tracked"), F.col("strict"))


@query(
    "G05_fail_fast_by_settings",
    f"""{RULED_SQL},
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY end_ms, role, idx) AS r FROM rt
          WHERE exit_code NOT IN (0, -105) AND (strict OR stops OR role = 'evaluator'
                OR role = 'worker' AND idx = 0 AND k NOT IN (SELECT k FROM tasks WHERE role = 'evaluator')))
    SELECT k, role, idx, end_ms AS at_ms, 'FAILED' AS status,
           concat('Job ', role, ':', idx, ' exited with ', exit_code, ' on host:', host, '. Exit status: ', exit_code) AS diagnostic
    FROM f WHERE r = 1""",
    RULED,
)
def fail_fast(t: Tables):
    return tasks.fail_fast(ruled(t), F.col("stops"), F.col("strict"), chief_role="evaluator")


@query(
    "J03_edges_by_settings",
    """n AS (SELECT k, role AS depends_on, count(*) AS waits_for FROM tasks GROUP BY k, role)
    SELECT k, role, depends_on, waits_for FROM app_edges JOIN n USING (k, depends_on)""",
    ("tasks", "app_edges"),
)
def edges_with_instances(t: Tables):
    n = tasks.role_summary(t.tasks).select("k", F.col("role").alias("depends_on"), F.col("instances").alias("waits_for"))
    return t.app_edges.join(n, ["k", "depends_on"])


@query(
    "W08_countdown_by_settings",
    """SELECT w.k, e.role, e.depends_on, finished_idx, at_ms, n - done AS left, n = done AS ready FROM
      (SELECT k, role AS dep, idx AS finished_idx, end_ms AS at_ms, exit_code, count(*) OVER (PARTITION BY k, role) AS n,
              count(*) FILTER (exit_code IS NOT NULL) OVER (PARTITION BY k, role ORDER BY end_ms, idx) AS done FROM tasks) w
      JOIN app_edges e ON e.depends_on = w.dep AND e.k = w.k WHERE exit_code IS NOT NULL""",
    ("tasks", "app_edges"),
)
def dependency_countdown(t: Tables):
    return tasks.dependency_countdown(t.tasks, t.app_edges, t.app_hot)


@query(
    "D03_ready_by_settings",
    """
    x AS (SELECT k, role, count(*) FILTER (NOT (exit_code IS NOT NULL AND end_ms <= start_ms + 1800000)) AS unfinished FROM tasks GROUP BY k, role)
    SELECT x.k, x.role FROM x ANTI JOIN (SELECT e.k, e.role FROM app_edges e JOIN x y ON y.k = e.k AND y.role = e.depends_on WHERE y.unfinished > 0) b
      ON b.k = x.k AND b.role = x.role""",
    ("tasks", "app_edges"),
)
def ready_roles(t: Tables):
    return tasks.ready_roles(t.tasks, t.app_edges, F.col("start_ms") + 1_800_000)


GROUP_SQL = """
    g AS (SELECT t.k, grp, bool_and(exit_code IS NOT NULL) AS done,
                 coalesce(max(end_ms) FILTER (exit_code IS NOT NULL), 0) AS latest_end, count(*) AS instances
          FROM tasks t JOIN app_members m ON m.k = t.k AND m.role = t.role GROUP BY t.k, grp)"""


@query("G14_groups_by_settings", f"{GROUP_SQL} SELECT k, grp, done, latest_end, CAST(instances AS BIGINT) AS instances FROM g", ("tasks", "app_members"))
def group_completion(t: Tables):
    return tasks.group_completion(tasks.role_summary(t.tasks), t.app_members)


@query(
    "T07_timeouts_by_settings",
    f"""{GROUP_SQL},
    one AS (SELECT DISTINCT ON (k, role) * FROM app_group_rules ORDER BY k, role, grp DESC),
    aw AS (SELECT w.k, w.role, r.grp, r.timeout_s, r.ignored, coalesce(done, true) AS done, coalesce(latest_end, 0) AS latest_end
           FROM (SELECT DISTINCT k, role FROM tasks WHERE exit_code IS NULL) w JOIN one r ON r.k = w.k AND r.role = w.role
           LEFT JOIN g ON g.k = w.k AND g.grp = r.grp),
    n AS (SELECT k, max(start_ms) + 3600000 AS now_ms FROM tasks GROUP BY k)
    SELECT k, role, grp, CASE WHEN ignored THEN 'UNTRACKED' ELSE 'FAILED' END AS outcome
    FROM aw JOIN n USING (k) WHERE done AND latest_end <> 0 AND now_ms - latest_end > CAST(timeout_s AS BIGINT) * 1000""",
    ("tasks", "app_members", "app_group_rules"),
)
def group_timeouts(t: Tables):
    judged = tasks.awaited_groups(tasks.role_summary(t.tasks), t.app_group_rules, t.app_members)
    now = t.tasks.groupBy("k").agg((F.max("start_ms") + 3_600_000).alias("now_ms"))
    return tasks.overdue(judged.join(now, "k"), F.col("now_ms")).select("k", "role", "grp", "outcome")
