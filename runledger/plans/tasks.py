"""Queries over task state: counters, statuses, dependencies, orders, timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import names, predicates
from runledger.operators import history, order, sets, tasks
from runledger.plans.history import STATUS_SQL
from runledger.plans.registry import query
from runledger.plans.scalars import DURATION_SQL, launched_tasks
from runledger.plans.tables import Tables

UNTRACKED = ["ps"]
# Point in time the timeout queries are asked for: 15 minutes after each application's first task.
LIMIT_MS = 900_000
HOUR = 3_600_000


def tracked():
    return predicates.is_monitored("role", UNTRACKED)


COUNTERS_SQL = """
    SELECT k, count(*) AS total, count(*) FILTER (WHERE role <> 'ps') AS tracked,
           count(exit_code) AS completed, count(exit_code) FILTER (WHERE role <> 'ps') AS completed_tracked,
           count(*) FILTER (WHERE exit_code NOT IN (0, -105)) AS failed
    FROM tasks GROUP BY k"""


@query("G02_task_counters", COUNTERS_SQL, ("tasks",))
def task_counters(t: Tables):
    return tasks.counters(t.tasks, tracked())


@query(
    "G03_progress",
    f"""c AS ({COUNTERS_SQL})
    SELECT k, CASE WHEN tracked = 0 THEN 0.0::DOUBLE ELSE completed_tracked / tracked END AS progress FROM c""",
    ("tasks",),
)
def progress(t: Tables):
    return tasks.progress(tasks.counters(t.tasks, tracked())).select("k", "progress")


FINAL_SQL = """
    s AS (SELECT k, count(*) FILTER (WHERE role <> 'ps') AS n,
              count(*) FILTER (WHERE role <> 'ps' AND exit_code IS NULL) AS open_n,
              min(concat(role, ':', lpad(CAST(idx AS VARCHAR), 9, '0'))) FILTER (WHERE role <> 'ps' AND exit_code IS NULL) AS first_open,
              count(*) FILTER (WHERE role <> 'ps' AND exit_code <> 0) AS failures FROM tasks GROUP BY k),
    final AS (SELECT k, CASE WHEN open_n > 0 OR (failures > 0 AND failures >= n) THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
           CASE WHEN open_n > 0 THEN concat('Job ', split_part(first_open, ':', 1), ':', CAST(split_part(first_open, ':', 2) AS INT), ' hasn''t finished yet.')
                WHEN failures > 0 AND failures >= n THEN concat('At least one job task exited with non-zero status, failedCnt=', failures)
                WHEN failures > 0 THEN concat('Training completed with some worker jobs failure, failedCnt=', failures) END AS message
    FROM s)"""


@query("G04_final_status", f"{FINAL_SQL} SELECT * FROM final", ("tasks",))
def final_status(t: Tables):
    return tasks.final_status(t.tasks, tracked())


CHIEF_SQL = "(role = 'evaluator' OR (role = 'worker' AND idx = 0 AND k NOT IN (SELECT k FROM tasks WHERE role = 'evaluator')))"


@query(
    "G05_fail_fast",
    f"""
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY end_ms, role, idx) AS r FROM tasks
          WHERE exit_code NOT IN (0, -105) AND (role = 'ps' OR {CHIEF_SQL}))
    SELECT k, role, idx, end_ms AS at_ms, 'FAILED' AS status,
           concat('Job ', role, ':', idx, ' exited with ', exit_code, ' on host:', host, '. Exit status: ', exit_code) AS diagnostic
    FROM f WHERE r = 1""",
    ("tasks",),
)
def fail_fast(t: Tables):
    return tasks.fail_fast(t.tasks, stop_roles=["ps"], chief_role="evaluator")


@query("F04_chief_task", f"SELECT k, role, idx FROM tasks WHERE {CHIEF_SQL}", ("tasks",))
def chief_task(t: Tables):
    return tasks.chief_tasks(t.tasks, chief_role="evaluator").select("k", "role", "idx")


@query(
    "F10_released_snapshot",
    f"""
    w AS (SELECT k FROM tasks GROUP BY k HAVING count(*) FILTER (WHERE NOT (exit_code IS NOT NULL OR host <> 'host7')) = 0)
    SELECT k, role, idx, {STATUS_SQL} AS status FROM tasks WHERE k IN (SELECT k FROM w)""",
    ("tasks",),
)
def released_snapshot(t: Tables):
    launched = F.col("exit_code").isNotNull() | (F.col("host") != "host7")
    return tasks.released_snapshot(t.tasks, launched).select(
        "k", "role", "idx", predicates.task_status("exit_code").alias("status")
    )


# Fixed: the groups, timeouts and edges the dependency queries ask about.
GROUPS = [("A", "worker"), ("A", "chief"), ("B", "ps")]
RULES = [("evaluator", "A", 3600, False), ("worker", "B", 1800, True), ("ps", "C", 60, False)]
EDGES = [("worker", "ps"), ("evaluator", "worker"), ("evaluator", "ps")]
MEMBERS_SQL = "(VALUES ('A', 'worker'), ('A', 'chief'), ('B', 'ps')) m(grp, role)"
RULES_SQL = "(VALUES ('evaluator', 'A', 3600, false), ('worker', 'B', 1800, true)) r(role, grp, timeout_s, ignored)"
EDGES_SQL = "(VALUES ('worker', 'ps'), ('evaluator', 'worker'), ('evaluator', 'ps')) e(role, depends_on)"


def members(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(GROUPS, "grp string, role string")


def rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(RULES, "role string, grp string, timeout_s int, ignored boolean")


def role_edges(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(EDGES, "role string, depends_on string")


GROUP_SQL = f"""
    g AS (SELECT k, grp, bool_and(exit_code IS NOT NULL) AS done,
                 coalesce(max(end_ms) FILTER (WHERE exit_code IS NOT NULL), 0) AS latest_end, count(*) AS instances
          FROM tasks JOIN {MEMBERS_SQL} USING (role) GROUP BY k, grp)"""
AWAIT_SQL = f"""{GROUP_SQL},
    aw AS (SELECT w.k, w.role, r.grp, r.timeout_s, r.ignored, coalesce(done, true) AS done, coalesce(latest_end, 0) AS latest_end
           FROM (SELECT DISTINCT k, role FROM tasks WHERE exit_code IS NULL) w JOIN {RULES_SQL} USING (role)
           LEFT JOIN g ON g.k = w.k AND g.grp = r.grp)"""


@query(
    "G14_group_completion",
    f"{GROUP_SQL} SELECT k, grp, done, latest_end, CAST(instances AS BIGINT) AS instances FROM g",
    ("tasks",),
)
def group_completion(t: Tables):
    return tasks.group_completion(tasks.role_summary(t.tasks), members(t))


@query("J04_awaited_groups", f"{AWAIT_SQL} SELECT * FROM aw", ("tasks",))
def awaited_groups(t: Tables):
    return tasks.awaited_groups(tasks.role_summary(t.tasks), rules(t), members(t))


TIMEOUT_SQL = f"""{AWAIT_SQL},
    n AS (SELECT k, max(start_ms) + 3600000 AS now_ms, bool_and(host <> 'host9') AS whole FROM tasks GROUP BY k)
    SELECT k, role, grp, CASE WHEN ignored THEN 'UNTRACKED' ELSE 'FAILED' END AS outcome
    FROM aw JOIN n USING (k) WHERE whole AND done AND latest_end <> 0 AND now_ms - latest_end > CAST(timeout_s AS BIGINT) * 1000"""


@query("T07_group_timeout", TIMEOUT_SQL, ("tasks",))
def group_timeout(t: Tables):
    judged = tasks.awaited_groups(tasks.role_summary(t.tasks), rules(t), members(t))
    now = t.tasks.groupBy("k").agg(
        (F.max("start_ms") + HOUR).alias("now_ms"), F.bool_and(F.col("host") != "host9").alias("whole")
    )
    return tasks.overdue(judged.join(now.where("whole"), "k"), F.col("now_ms")).select("k", "role", "grp", "outcome")


@query(
    "J03_dependency_instances",
    f"""SELECT k, e.role, depends_on, waits_for FROM {EDGES_SQL}
    JOIN (SELECT k, role AS dep, count(*) AS waits_for FROM tasks GROUP BY k, role) d ON d.dep = e.depends_on
    JOIN (SELECT DISTINCT k AS k2, role AS r2 FROM tasks) x ON x.k2 = d.k AND x.r2 = e.role""",
    ("tasks",),
)
def dependency_instances(t: Tables):
    present = tasks.role_summary(t.tasks).select("k", "role", "instances")
    edges = present.select("k", "role").join(role_edges(t), "role")
    asked = present.select("k", F.col("role").alias("depends_on"), F.col("instances").alias("waits_for"))
    return edges.join(asked, ["k", "depends_on"])


@query(
    "W08_dependency_countdown",
    f"""SELECT k, e.role, depends_on, finished_idx, at_ms, n - done AS left, n = done AS ready FROM
      (SELECT k, role AS dep, idx AS finished_idx, end_ms AS at_ms, exit_code,
              count(*) OVER (PARTITION BY k, role) AS n,
              count(*) FILTER (WHERE exit_code IS NOT NULL) OVER (PARTITION BY k, role ORDER BY end_ms, idx) AS done FROM tasks) w
      JOIN {EDGES_SQL} ON e.depends_on = w.dep WHERE exit_code IS NOT NULL""",
    ("tasks",),
)
def dependency_countdown(t: Tables):
    return tasks.dependency_countdown(t.tasks, role_edges(t), t.app_hot)


@query(
    "D03_ready_roles",
    f"""
    x AS (SELECT k, role, count(*) FILTER (WHERE NOT (exit_code IS NOT NULL AND end_ms <= start_ms + 1800000)) AS unfinished FROM tasks GROUP BY k, role)
    SELECT k, role FROM x WHERE NOT EXISTS (SELECT 1 FROM {EDGES_SQL} JOIN x y ON y.role = e.depends_on WHERE e.role = x.role AND y.k = x.k AND y.unfinished > 0)""",
    ("tasks",),
)
def ready_roles(t: Tables):
    return tasks.ready_roles(t.tasks, role_edges(t), F.col("start_ms") + 1_800_000)


PRIORITY_SQL = "CASE role WHEN 'evaluator' THEN 0 WHEN 'ps' THEN 1 ELSE 2 END"


@query(
    "J08_arrival_matching",
    f"""
    a AS (SELECT k, {PRIORITY_SQL} AS priority, start_ms AS ts_ms, idx AS id,
                 row_number() OVER (PARTITION BY k, role ORDER BY start_ms, idx) AS n FROM tasks),
    s AS (SELECT k, {PRIORITY_SQL} AS priority, role, idx, row_number() OVER (PARTITION BY k, role ORDER BY idx) AS n FROM tasks WHERE host <> 'host2')
    SELECT a.k, a.priority, a.ts_ms, a.id, s.role, s.idx FROM a LEFT JOIN s ON a.k = s.k AND a.priority = s.priority AND a.n = s.n""",
    ("tasks",),
)
def arrival_matching(t: Tables):
    priority = (
        F.when(F.col("role") == "evaluator", 0).when(F.col("role") == "ps", 1).otherwise(2).alias("priority")
    )
    arrivals = t.tasks.select("k", priority, F.col("start_ms").alias("ts_ms"), F.col("idx").alias("id"))
    slots = t.tasks.where(F.col("host") != "host2").select("k", priority, "role", "idx")
    return tasks.match_arrivals(arrivals, slots, t.app_hot)


@query(
    "J10_failed_unregistered",
    """SELECT k, role, idx FROM tasks WHERE exit_code NOT IN (0, -105)
       AND (idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5')""",
    ("tasks",),
)
def failed_unregistered(t: Tables):
    rows = launched_tasks(t)
    registered = rows.where(F.col("host").isNotNull()).select("k", "role", "idx")
    return tasks.failed_unregistered(rows, registered).select("k", "role", "idx")


@query(
    "G17_status_summary",
    f"""
    p AS (SELECT k, role, idx, {STATUS_SQL} AS status FROM tasks),
    q AS (SELECT *, idx - row_number() OVER (PARTITION BY k, status, role ORDER BY idx) AS run FROM p)
    SELECT k, status, role, min(idx) AS first, max(idx) AS last,
           CAST(list_position(['FAILED', 'SUCCEEDED', 'FINISHED', 'RUNNING', 'NEW', 'READY'], status) AS INT) AS attention
    FROM q GROUP BY k, status, role, run""",
    ("tasks",),
)
def status_summary(t: Tables):
    return tasks.status_runs(t.tasks, t.app_hot)


@query(
    "G18_gang_state",
    """
    SELECT k, count(*) FILTER (WHERE NOT (idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5')) AS registered,
           count(*) AS expected,
           count(*) FILTER (WHERE idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5') = 0 AS ready
    FROM tasks GROUP BY k""",
    ("tasks",),
)
def gang_state(t: Tables):
    return tasks.gang_state(launched_tasks(t), F.col("host").isNotNull())


@query(
    "G19_dashboard",
    f"""
    c AS (SELECT k, count(*) AS total, count(*) FILTER (WHERE host <> 'host3') AS registered FROM tasks GROUP BY k)
    SELECT k, total, registered, strftime(epoch_ms(started_ms), '%Y-%m-%d %H:%M:%S') AS start_time,
           {DURATION_SQL.format(s="(86400000 * (1 + k % 3) + k * 1000) // 1000")} AS duration
    FROM apps JOIN c USING (k)""",
    ("apps", "tasks"),
)
def dashboard(t: Tables):
    state = tasks.gang_state(t.tasks, F.col("host") != "host3").select(
        "k", F.col("expected").alias("total"), "registered"
    )
    now = F.col("started_ms") + 86_400_000 * (1 + F.col("k") % 3) + F.col("k") * 1000
    return t.apps.join(state, "k").select(
        "k", "total", "registered",
        F.date_format(names.zoned("started_ms", "UTC"), "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        names.duration_text(now - F.col("started_ms")).alias("duration"),
    )


@query(
    "G19_dashboard_tasks",
    f"""
    SELECT k, concat(role, ':', idx) AS task_id, {STATUS_SQL} AS status,
           strftime(epoch_ms(start_ms), '%Y-%m-%d %I:%M:%S') AS started,
           CASE WHEN exit_code IS NULL THEN '' ELSE strftime(epoch_ms(end_ms), '%Y-%m-%d %I:%M:%S') END AS ended
    FROM tasks""",
    ("tasks",),
)
def dashboard_tasks(t: Tables):
    shown = lambda ms: F.date_format(names.zoned(ms, "UTC"), "yyyy-MM-dd hh:mm:ss")
    return t.tasks.select(
        "k", names.task_id("role", "idx").alias("task_id"), predicates.task_status("exit_code").alias("status"),
        shown("start_ms").alias("started"),
        F.when(F.col("exit_code").isNull(), "").otherwise(shown("end_ms")).alias("ended"),
    )


@query(
    "O02_attention_order",
    f"""
    p AS (SELECT k, role, idx, {STATUS_SQL} AS status FROM tasks)
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY list_position(['FAILED', 'SUCCEEDED', 'FINISHED', 'RUNNING'], status), role, idx) AS place FROM p""",
    ("tasks",),
)
def attention_order(t: Tables):
    rows = t.tasks.select("k", "role", "idx", predicates.task_status("exit_code").alias("status"))
    return order.by_attention(rows, t.app_hot)


@query(
    "O03_task_id_order",
    "SELECT k, role, idx, row_number() OVER (PARTITION BY k ORDER BY role, CAST(idx AS VARCHAR)) AS place FROM tasks",
    ("tasks",),
)
def task_id_order(t: Tables):
    return order.by_task_id(t.tasks.select("k", "role", "idx"), t.app_hot)


@query(
    "O05_first_lines",
    """
    SELECT task, CASE WHEN text = '' THEN '' ELSE concat(array_to_string(
        list_slice(string_split(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '\\n$', ''), chr(10)), 1, 5), chr(10)), chr(10)) END AS head FROM logs""",
    ("logs",),
)
def first_lines(t: Tables):
    return t.logs.select("task", order.first_lines("text", 5).alias("head"))


@query(
    "U03_missing_tasks",
    """SELECT k, role, idx FROM tasks WHERE idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5'""",
    ("tasks",),
)
def missing_tasks(t: Tables):
    rows = launched_tasks(t)
    ids = ["k", "role", "idx"]
    return sets.missing_tasks(rows.select(*ids), rows.where(F.col("host").isNotNull()).select(*ids))


@query(
    "U04_snapshot_difference",
    f"""
    b AS (SELECT k, role, idx, {STATUS_SQL} AS status FROM tasks),
    c AS (SELECT k, role, idx, CASE WHEN host = 'host4' THEN 'FAILED' ELSE status END AS status
          FROM (SELECT k, role, idx, host, {STATUS_SQL} AS status FROM tasks) x)
    SELECT *, 'before' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c) y
    UNION ALL SELECT *, 'after' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b) z""",
    ("tasks",),
)
def snapshot_difference(t: Tables):
    status = predicates.task_status("exit_code")
    later = F.when(F.col("host") == "host4", "FAILED").otherwise(status)
    return sets.revised(t.tasks, ["k", "role", "idx"], {"status": status}, {"status": later})


@query(
    "T04_registration_timeout",
    f"""SELECT k, role, idx, start_ms FROM tasks WHERE (idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5')
       AND (start_ms + (k % 40) * 60000) - start_ms > {LIMIT_MS}""",
    ("tasks",),
)
def registration_timeout(t: Tables):
    now = F.col("start_ms") + (F.col("k") % 40) * 60_000
    return tasks.registration_timeouts(launched_tasks(t), LIMIT_MS, now).select("k", "role", "idx", "start_ms")


@query(
    "T05_allocation_timeout",
    f"""SELECT k, min(start_ms) AS since_ms,
           count(*) FILTER (WHERE NOT (idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5')) AS registered, count(*) AS expected
    FROM tasks GROUP BY k HAVING count(*) FILTER (WHERE idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5') > 0
       AND max(start_ms + (k % 40) * 60000) - min(start_ms) > {LIMIT_MS}""",
    ("tasks",),
)
def allocation_timeout(t: Tables):
    now = F.col("start_ms") + (F.col("k") % 40) * 60_000
    return tasks.allocation_timeouts(launched_tasks(t), F.col("host").isNotNull(), LIMIT_MS, now)


@query(
    "T06_app_timeout",
    """SELECT k, started_ms, CASE WHEN completed_ms = -1 THEN started_ms + k * 60000 ELSE completed_ms END - started_ms AS elapsed_ms FROM apps
       WHERE CASE WHEN completed_ms = -1 THEN started_ms + k * 60000 ELSE completed_ms END > started_ms + 36000000""",
    ("apps",),
)
def app_timeout(t: Tables):
    now = F.when(F.col("completed_ms") == -1, F.col("started_ms") + F.col("k") * 60_000).otherwise(F.col("completed_ms"))
    return tasks.app_timeouts(t.apps, 36_000_000, now).select("k", "started_ms", "elapsed_ms")


@query(
    "T09_task_state",
    f"""
    f AS (SELECT k, role, idx, exit_code, ts_ms, row_number() OVER (PARTITION BY k, role, idx ORDER BY ts_ms, file_pos) AS r FROM event_log WHERE kind = 'TASK_FINISHED'),
    s AS (SELECT k, role, idx, min(ts_ms) AS running_ms FROM event_log WHERE kind = 'TASK_STARTED' GROUP BY k, role, idx)
    SELECT s.k, s.role, s.idx, running_ms, f.ts_ms AS ended_ms, {STATUS_SQL} AS status
    FROM s LEFT JOIN f ON s.k = f.k AND s.role = f.role AND s.idx = f.idx AND r = 1""",
    ("event_log",),
)
def task_state(t: Tables):
    return tasks.first_terminal_status(t.event_log).drop("exit_code")


FLAGS_SQL = """
    fl AS (SELECT k, count(*) FILTER (WHERE role <> 'ps') AS n,
              count(exit_code) FILTER (WHERE role <> 'ps') AS done,
              bool_or(role = 'ps' AND coalesce(exit_code NOT IN (0, -105), false)) AS untracked_failed,
              bool_or(coalesce(exit_code NOT IN (0, -105), false) AND (idx = 1 AND host = 'host3')) AS startup_failed,
              max(end_ms) - min(start_ms) AS span FROM tasks GROUP BY k)"""


@query(
    "T16_termination_reason",
    f"""{FLAGS_SQL}
    SELECT k, CASE WHEN span > 3000000 THEN 'timeout' WHEN untracked_failed THEN 'untracked_failed' WHEN startup_failed THEN 'startup_failed'
         WHEN n > 0 AND done = n THEN 'all_tracked_done' END AS reason FROM fl""",
    ("tasks",),
)
def termination_reason(t: Tables):
    off = predicates.is_untracked("role", UNTRACKED)
    late = (F.col("idx") == 1) & (F.col("host") == "host3")
    flags = t.tasks.groupBy("k").agg(
        F.count_if(tracked()).alias("n"),
        F.count_if(tracked() & predicates.is_completed()).alias("done"),
        F.bool_or(off & predicates.is_failed()).alias("untracked_failed"),
        F.bool_or(predicates.is_failed() & late).alias("startup_failed"),
        (F.max("end_ms") - F.min("start_ms")).alias("span"),
    )
    reason = tasks.termination_reason(
        {
            "timeout": F.col("span") > 3_000_000,
            "untracked_failed": F.col("untracked_failed"),
            "startup_failed": F.col("startup_failed"),
            "all_tracked_done": (F.col("n") > 0) & (F.col("done") == F.col("n")),
        }
    )
    return flags.select("k", reason.alias("reason"))


@query("T17_untracked_failure", f"{FLAGS_SQL} SELECT k, untracked_failed FROM fl", ("tasks",))
def untracked_failure(t: Tables):
    return tasks.untracked_failures(t.tasks, predicates.is_untracked("role", UNTRACKED))


@query(
    "app_overview",
    f"""{FINAL_SQL},
    c AS ({COUNTERS_SQL})
    SELECT a.k, a.app_id, a.started_ms, a.completed_ms, a.usr, a.status AS recorded_status,
           coalesce(total, 0) AS total, coalesce(tracked, 0) AS tracked, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed,
           coalesce(final.status, 'SUCCEEDED') AS derived_status, final.message,
           row_number() OVER (ORDER BY completed_ms DESC, started_ms DESC, usr, a.k) AS place
    FROM apps a LEFT JOIN c ON a.k = c.k LEFT JOIN final ON a.k = final.k""",
    ("apps", "tasks"),
)
def app_overview(t: Tables):
    """All applications, newest first, read back from their history file names, with task
    counters and the status their tasks add up to."""
    status = F.when(F.col("completed_ms") != -1, F.col("status"))
    name = names.build_history_name("app_id", "started_ms", "completed_ms", "usr", status)
    files = t.apps.select("k", name.alias("name")).where(names.is_valid_history_name("name"))
    listed = files.select("k", names.parse_history_name("name").alias("m")).select("k", "m.*")
    derived = tasks.final_status(t.tasks, tracked(), counted=True).withColumnRenamed("status", "derived_status")
    seen = listed.join(derived, "k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return history.ranked_app_list(seen, "k").select(
        "k", "app_id", "started_ms", "completed_ms", "usr", F.col("status").alias("recorded_status"),
        zero("total"), zero("tracked"), zero("completed"), zero("failed"),
        F.coalesce("derived_status", F.lit("SUCCEEDED")).alias("derived_status"), "message", "place",
    )
