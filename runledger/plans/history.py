"""Queries over application history: events, attempts, roll-ups, lists, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import names
from runledger.operators import history
from runledger.plans.registry import query
from runledger.plans.scalars import with_container
from runledger.plans.tables import Tables

ATTEMPT_SQL = """a AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN kind = 'APPLICATION_INITED' THEN 1 ELSE 0 END)
        OVER (PARTITION BY k ORDER BY file_pos) AS BIGINT) AS attempt FROM event_log)"""
STATUS_SQL = """CASE WHEN exit_code IS NULL THEN 'RUNNING' WHEN exit_code = 0 THEN 'SUCCEEDED'
        WHEN exit_code = -105 THEN 'FINISHED' ELSE 'FAILED' END"""


@query(
    "W01_attempt_number",
    f"{ATTEMPT_SQL} SELECT k, file_pos, kind, attempt, attempt - 1 AS session_id FROM a",
    ("event_log",),
)
def attempt_number(t: Tables):
    return history.attempts(t.event_log, t.app_hot).select("k", "file_pos", "kind", "attempt", "session_id")


@query(
    "F08_current_attempt",
    f"""{ATTEMPT_SQL}, m AS (SELECT k, max(attempt) AS last FROM a GROUP BY k)
    SELECT k, file_pos, kind, attempt FROM a JOIN m USING (k)
    WHERE kind NOT LIKE 'TASK%' OR attempt = last""",
    ("event_log",),
)
def current_attempt(t: Tables):
    return history.current_attempt(t.event_log, t.hot_apps).select("k", "file_pos", "kind", "attempt")


@query(
    "J06_task_lifecycle",
    f"""{ATTEMPT_SQL},
    p AS (SELECT k, attempt, role, idx, min(ts_ms) FILTER (kind = 'TASK_STARTED') AS start_ms, min(ts_ms) FILTER (kind = 'TASK_FINISHED') AS end_ms,
                 min(exit_code) FILTER (kind = 'TASK_FINISHED') AS exit_code
          FROM a WHERE kind IN ('TASK_STARTED', 'TASK_FINISHED') GROUP BY k, attempt, role, idx)
    SELECT k, attempt, role, idx, start_ms, end_ms, end_ms - start_ms AS duration_ms,
           CASE WHEN exit_code IS NULL THEN 'RUNNING' WHEN exit_code = 0 THEN 'SUCCEEDED' WHEN exit_code = -105 THEN 'FINISHED' ELSE 'FAILED' END AS status
    FROM p WHERE start_ms IS NOT NULL""",
    ("event_log",),
)
def task_lifecycle(t: Tables):
    return history.task_lifecycles(t.event_log, t.app_hot).drop("exit_code")


@query(
    "G16_app_rollup",
    """
    g AS (SELECT k, min(ts_ms) FILTER (WHERE kind = 'APPLICATION_INITED') AS start_ms,
                 coalesce(max(ts_ms) FILTER (WHERE kind = 'APPLICATION_FINISHED'), -1) AS end_ms,
                 count(*) FILTER (WHERE kind = 'TASK_FINISHED') AS finished_tasks,
                 count(*) FILTER (WHERE kind = 'TASK_FINISHED' AND exit_code NOT IN (0, -105)) AS failed_tasks,
                 count(*) FILTER (WHERE kind = 'APPLICATION_INITED') AS attempts
          FROM event_log GROUP BY k)
    SELECT *, CASE WHEN end_ms <> -1 THEN end_ms - start_ms END AS duration_ms,
           CASE WHEN end_ms = -1 THEN 'RUNNING' WHEN failed_tasks > 0 AND failed_tasks >= finished_tasks THEN 'FAILED'
                ELSE 'SUCCEEDED' END AS status FROM g""",
    ("event_log",),
)
def app_rollup(t: Tables):
    return history.app_rollup(t.event_log)


def _files(t: Tables):
    """History files of all attempts: every tenth application has a second one."""
    second = t.apps.where("k % 10 = 0").withColumn("started_ms", F.col("started_ms") + 1200000)
    status = F.when(F.col("completed_ms") != -1, F.col("status"))
    name = names.build_history_name("app_id", "started_ms", "completed_ms", "usr", status)
    return t.apps.unionByName(second).select(name.alias("name"))


@query(
    "G01_newest_attempt_file",
    """
    f AS (SELECT * FROM apps UNION ALL SELECT k, app_id, started_ms + 1200000, completed_ms, usr, status FROM apps WHERE k % 10 = 0),
    n AS (SELECT app_id, started_ms, concat(app_id, '-', started_ms, CASE WHEN completed_ms = -1 THEN '' ELSE concat('-', completed_ms) END,
           '-', usr, CASE WHEN completed_ms = -1 THEN '.jhist.inprogress' ELSE concat('-', status, '.jhist') END) AS name FROM f)
    SELECT app_id, started_ms, name FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY started_ms DESC, name DESC) AS r FROM n) x WHERE r = 1""",
    ("apps",),
)
def newest_attempt_file(t: Tables):
    return history.newest_history_file(_files(t))


@query(
    "J01_logs_with_user",
    """
    SELECT e.k, e.file_pos, e.host, concat('container_', e.k, '_', e.file_pos) AS container,
           CASE WHEN usr IS NULL THEN 'NA' ELSE concat('http://', e.host, ':8042/node/containerlogs/container_', e.k, '_', e.file_pos, '/', usr) END AS link
    FROM event_log e LEFT JOIN (SELECT k, usr FROM apps WHERE k % 3 <> 0) a ON e.k = a.k
    WHERE kind IN ('APPLICATION_INITED', 'TASK_STARTED')""",
    ("event_log",),
)
def logs_with_user(t: Tables):
    known = t.apps.where("k % 3 <> 0")
    return history.container_links(with_container(t), known, "0.0.0.0:8042", t.hot_apps).select(
        "k", "file_pos", "host", "container", "link"
    )


@query(
    "U01_finished_and_landing",
    """
    l AS (SELECT app_id, usr, 'RUNNING' AS status, started_ms FROM apps WHERE k % 4 = 0),
    f AS (SELECT app_id, usr, status, started_ms FROM apps WHERE k % 2 = 0)
    SELECT * FROM l UNION ALL SELECT * FROM f WHERE app_id NOT IN (SELECT app_id FROM l)""",
    ("apps",),
)
def finished_and_landing(t: Tables):
    columns = ["app_id", "usr", "status", "started_ms"]
    finished = t.apps.where("k % 2 = 0").select(*columns)
    landing = t.apps.where("k % 4 = 0").withColumn("status", F.lit("RUNNING")).select(*columns)
    return history.merge_app_lists("app_id", finished, landing)


@query(
    "O01_app_list",
    """
    SELECT k, app_id, completed_ms, started_ms, usr, status,
           row_number() OVER (ORDER BY completed_ms DESC, started_ms DESC, usr, k) AS place FROM apps""",
    ("apps",),
)
def app_list(t: Tables):
    return history.ranked_app_list(t.apps, "k").select(
        "k", "app_id", "completed_ms", "started_ms", "usr", "status", "place"
    )


@query(
    "O04_newest_apps",
    "SELECT k, app_id, started_ms FROM apps ORDER BY started_ms DESC, k LIMIT 10000",
    ("apps",),
)
def newest_apps(t: Tables):
    return history.newest_apps(t.apps, 10_000, "k").select("k", "app_id", "started_ms")


@query(
    "O06_app_page",
    """
    SELECT k, app_id, completed_ms, started_ms, usr FROM apps
    ORDER BY completed_ms DESC, started_ms DESC, usr, k LIMIT 25 OFFSET 75""",
    ("apps",),
)
def app_page(t: Tables):
    return history.app_page(t.apps, page=3, tie="k").select("k", "app_id", "completed_ms", "started_ms", "usr")
