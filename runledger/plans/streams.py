"""Streaming queries (T), each run over several micro-batches of a file stream and held against its batch SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import names, predicates
from runledger.operators import graph, rules, tasks, telemetry
from runledger.plans.registry import ORACLES, query
from runledger.plans.scalars import launched_tasks
from runledger.plans.tables import Tables, pings_of, samples_of
from runledger.plans.tasks import LIMIT_MS, UNTRACKED, role_edges
from runledger.plans.telemetry import AVERAGE_SQL, EXPIRY_MS, GAP_SQL
from runledger.session import scratch_dir, written
from runledger.streaming import jobs, keyed, liveness, states
from runledger.streaming.running import drain, state_of, stream_of

DELAY, DELAY_MS = "61500 milliseconds", 61_500
ATTEMPT_MS = 3_600_000  # how long an event waits for a newer attempt


BATCHES, FILE_ROWS = 4, 250_000


def _stored(t: Tables, rows: DataFrame, label: str) -> DataFrame:
    """A table derived by Spark, written out and read back as a stream of one micro-batch."""
    path = scratch_dir(t.spark, f"{label}-source")
    rows.write.parquet(path)
    return stream_of(t.spark, path, rows.schema)


def _stream(
    t: Tables, rows: DataFrame, label: str, by: str = "ts_ms", last: DataFrame | None = None, stored: bool = False, bounded: bool = False
) -> DataFrame:
    """A table derived by Spark as a stream of ``BATCHES`` micro-batches in the order of time; ``last`` comes after them.

    ``stored``: the rows need only be read. ``bounded``: of a larger table a micro-batch holds a file of ``FILE_ROWS`` for
    each core, so that what waits in a join does not grow with the table.
    """
    kept = rows if stored else written(rows, f"{label}-rows")
    many, cores = kept.count(), t.spark.sparkContext.defaultParallelism
    path = scratch_dir(t.spark, f"{label}-source")
    if bounded and many > BATCHES * FILE_ROWS * cores and _ranged(t, kept, many, by, path):
        files = cores
    else:
        files = max(1, many // BATCHES // FILE_ROWS)
        cuts = kept.approxQuantile(by, [i / BATCHES for i in range(1, BATCHES)], 0.01)
        part = sum((F.when(F.col(by) > c, 1).otherwise(0) for c in cuts), F.lit(0))
        for i in range(BATCHES):
            kept.where(part == i).repartition(files).write.mode("overwrite" if i == 0 else "append").parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    return stream_of(t.spark, path, rows.schema, files_per_batch=files)


def _ranged(t: Tables, kept: DataFrame, many: int, by: str, path: str) -> bool:
    """Write files of ``FILE_ROWS`` in the order of time; a stream takes the file that was changed first. False where the
    store does not keep the times that files are given."""
    kept.repartitionByRange(-(-many // FILE_ROWS), by).write.parquet(path)
    base = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    found = lambda: sorted((f for f in fs.listStatus(base) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = int(time.time()) - many // FILE_ROWS - 60
    for i, f in enumerate(found()):
        fs.setTimes(f.getPath(), (first + i) * 1000, -1)
    times = [f.getModificationTime() for f in found()]
    return all(a < b for a, b in zip(times, times[1:]))


def _events(t: Tables) -> DataFrame:
    """The events table as a stream; the pattern lets it be one file or a folder of many."""
    return stream_of(t.spark, f"{t.dir}/events.[p]arquet", t.raw("events").schema)


def _log(t: Tables) -> DataFrame:
    return _stream(t, t.event_log, "event-log")


@query("T01_event_ingest", "SELECT k, ts_ms, kind, role, idx, host, exit_code, file_pos FROM event_log", ("event_log",))
def event_ingest(t: Tables):
    path = scratch_dir(t.spark, "ingested")
    jobs.ingest_events(_stored(t, t.event_log, "event-log"), path, f"{path}-state", period="yyyy-MM")
    return t.spark.read.parquet(path).select("k", "ts_ms", "kind", "role", "idx", "host", "exit_code", "file_pos")


RUNS_SQL = f"""
    g AS ({GAP_SQL}),
    r AS (SELECT *, sum(CASE WHEN previous_ms IS NULL OR ts_ms - previous_ms > {EXPIRY_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts_ms, id) AS session FROM g),
    runs AS (SELECT task, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS calls,
                 coalesce(max_by(kind, (ts_ms, id)) FILTER (WHERE kind IN ('register', 'result')) = 'register', false) AS monitored
             FROM r GROUP BY task, session),
    closed AS (SELECT * FROM runs WHERE last_ms + {EXPIRY_MS} + 1 <= (SELECT max(ts_ms) - {DELAY_MS} FROM pings))"""
DEAD_SQL = f"{RUNS_SQL} SELECT task, last_ms, last_ms + {EXPIRY_MS} AS dead_ms FROM closed WHERE monitored"


@query("T02_dead_tasks_stream", DEAD_SQL, ("pings",))
def dead_tasks_stream(t: Tables):
    return drain(liveness.dead_tasks(pings_of(_events(t)), EXPIRY_MS, DELAY), label="dead-tasks")


@query("T02_dead_tasks", DEAD_SQL, ("pings",))
def dead_tasks(t: Tables):
    clock = t.pings.agg((F.max("ts_ms") - DELAY_MS).alias("now")).select("now").scalar()
    return telemetry.dead_tasks(telemetry.liveness_sessions(t.pings, EXPIRY_MS, t.task_hot), EXPIRY_MS, clock)


@query("T03_liveness_sessions_stream", f"{RUNS_SQL} SELECT * FROM closed", ("pings",))
def liveness_sessions_stream(t: Tables):
    return drain(liveness.liveness_sessions(pings_of(_events(t)), EXPIRY_MS, DELAY), label="sessions")


@query("T03_liveness_sessions", f"{RUNS_SQL} SELECT * FROM runs", ("pings",))
def liveness_sessions(t: Tables):
    return telemetry.liveness_sessions(t.pings, EXPIRY_MS, t.task_hot).drop("session")


REGISTER_SQL = """
    l AS (SELECT concat(k, '/', role, ':', idx) AS task_id, k, start_ms AS ts_ms, start_ms + (k % 40) * 60000 AS reg_ms,
                 NOT (idx = 1 AND host = 'host3' OR coalesce(exit_code IS NULL AND host = 'host5', false)) AS registers FROM tasks)"""


def _launches(t: Tables) -> DataFrame:
    tid = F.concat(F.col("k").cast("string"), F.lit("/"), names.task_id("role", "idx"))
    return launched_tasks(t).select(
        tid.alias("task_id"), "k", F.col("start_ms").alias("ts_ms"),
        F.when(F.col("host").isNotNull(), F.col("start_ms") + (F.col("k") % 40) * 60_000).alias("reg_ms"),
    )


@query(
    "T04_registration_timeout_stream",
    f"""{REGISTER_SQL}, w AS (SELECT least(max(ts_ms), max(reg_ms) FILTER (WHERE registers)) - {DELAY_MS} AS mark FROM l)
    SELECT task_id, ts_ms FROM l, w WHERE NOT (registers AND reg_ms - ts_ms <= {LIMIT_MS}) AND ts_ms + {LIMIT_MS} < mark""",
    ("tasks",),
)
def registration_timeout_stream(t: Tables):
    rows = written(_launches(t).select("task_id", "ts_ms", "reg_ms"), "launched")
    launches = _stream(t, rows.select("task_id", "ts_ms"), "launches", stored=True, bounded=True)
    came = rows.where(F.col("reg_ms").isNotNull()).select("task_id", F.col("reg_ms").alias("ts_ms"))
    late = liveness.registration_timeouts(launches, _stream(t, came, "registrations", stored=True, bounded=True), LIMIT_MS, DELAY)
    return drain(late, label="registration-timeouts")


def _starts(t: Tables) -> DataFrame:
    """The start of each application whose log (by time, and at one time the start first) begins with it: ``file_pos`` is 0.

    One number an event, so that all combine on the map side and no log is sorted.
    """
    first = F.coalesce(F.col("ts_ms") * 2, F.lit(-(2**63))) + F.when(F.col("kind") == "APPLICATION_INITED", 0).otherwise(1)
    firsts = t.event_log.groupBy("k").agg(F.min(first).alias("_first")).where("_first % 2 = 0")
    return firsts.select("k", F.when(F.col("_first") > -(2**63), F.floor(F.col("_first") / 2)).alias("ts_ms"))


@query(
    "T05_allocation_timeout_stream",
    f"""s AS (SELECT k, role, idx, start_ms FROM tasks UNION ALL SELECT k, 'standby', 0, NULL FROM apps WHERE k % 3 = 0),
    w AS (SELECT least((SELECT max(started_ms) FROM apps), (SELECT max(start_ms) FROM tasks)) - {DELAY_MS} AS mark)
    SELECT k, role, idx, started_ms AS since_ms FROM s JOIN apps USING (k), w
    WHERE coalesce(start_ms - started_ms > {LIMIT_MS}, true) AND started_ms + {LIMIT_MS} < mark""",
    ("apps", "tasks"),
)
def allocation_timeout_stream(t: Tables):
    t.write_once("tasks")
    standby = t.apps.where("k % 3 = 0").select("k", F.lit("standby").alias("role"), F.lit(0).alias("idx"))
    slots = t.tasks.select("k", "role", "idx").unionByName(standby)
    launches = t.event_log.where("kind = 'TASK_STARTED'").select("k", "role", "idx", "ts_ms")
    late = liveness.allocation_timeouts(
        _stream(t, _starts(t), "starts"), written(slots, "slots"), _stream(t, launches, "launches"), LIMIT_MS, DELAY
    )
    return drain(late, label="allocation-timeouts", joined=True).withColumnRenamed("ts_ms", "since_ms")


@query(
    "T06_app_timeout_stream",
    f"""w AS (SELECT least(max(started_ms), max(completed_ms)) - {DELAY_MS} AS mark FROM apps)
    SELECT k, started_ms, started_ms + 36000000 AS due_ms FROM apps, w
    WHERE (completed_ms = -1 OR completed_ms - started_ms > 36000000) AND started_ms + 36000000 < mark""",
    ("apps",),
)
def app_timeout_stream(t: Tables):
    ends = t.event_log.where("kind = 'APPLICATION_FINISHED'").select("k", "ts_ms")
    late = liveness.app_timeouts(_stream(t, _starts(t), "starts"), _stream(t, ends, "ends"), 36_000_000, DELAY)
    return drain(late, label="app-timeouts").select("k", F.col("ts_ms").alias("started_ms"), (F.col("ts_ms") + 36_000_000).alias("due_ms"))


GROUPS_SQL = """
    gr AS (SELECT t.k, grp, bool_and(exit_code IS NOT NULL) AS done, max(end_ms) AS latest_end
           FROM tasks t JOIN app_members m ON m.k = t.k AND m.role = t.role GROUP BY t.k, grp),
    run AS (SELECT k, role, bool_or(exit_code IS NULL) AS open, max(end_ms) FILTER (exit_code IS NOT NULL) AS last_end FROM tasks GROUP BY k, role),
    one AS (SELECT DISTINCT ON (k, role) * FROM app_group_rules ORDER BY k, role, grp DESC),
    overdue AS (SELECT k, role, grp, CASE WHEN ignored THEN 'UNTRACKED' ELSE 'FAILED' END AS outcome, latest_end + CAST(timeout_s AS BIGINT) * 1000 AS at_ms
           FROM run JOIN one USING (k, role) JOIN gr USING (k, grp)
           WHERE done AND (open OR last_end > latest_end + CAST(timeout_s AS BIGINT) * 1000))"""


@query(
    "T07_group_timeout_stream",
    f"""{GROUPS_SQL}, w AS (SELECT max(end_ms) - {DELAY_MS} AS mark FROM tasks WHERE exit_code IS NOT NULL)
    SELECT k, role, grp, outcome, at_ms FROM overdue, w WHERE at_ms < mark""",
    ("tasks", "app_members", "app_group_rules"),
)
def group_timeout_stream(t: Tables):
    """Rules of each application, alarms as their limits pass."""
    roles = tasks.role_summary(t.tasks).select("k", "role", "instances")
    # Applications of one day share a state, in parts.
    day = t.apps.select("k", F.concat(F.floor(F.col("started_ms") / 86_400_000), F.lit("/"), F.col("k") % 8).alias("bucket"))
    watch = written(keyed.watched(roles, t.app_group_rules, t.app_members).join(day, "k"), "watch")
    return drain(keyed.group_timeouts(_log(t), watch, DELAY), label="group-timeouts", keyed=True)


@query(
    "T08_metric_state",
    f"""{AVERAGE_SQL},
    a AS (SELECT task, max(n) + 1 AS refreshes, round(max_by(avg_value, n), 6) AS avg_value FROM fold GROUP BY task),
    m AS (SELECT task, greatest(coalesce(max(value), -1), -1) AS max_value FROM samples GROUP BY task),
    l AS (SELECT task, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts_ms DESC, id DESC) AS r FROM samples) x WHERE r = 1)
    SELECT task, refreshes, avg_value, max_value, ts_ms, value FROM a JOIN m USING (task) JOIN l USING (task)""",
    ("samples",), recursive=True,
)
def metric_state(t: Tables):
    out = state_of(keyed.metric_state(_stream(t, t.samples, "samples")), ["task"], "metrics", keyed=True)
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("T09_task_state_stream", ORACLES["T09_task_state"])
def task_state_stream(t: Tables):
    return state_of(states.task_states(_log(t)), ["k", "role", "idx"], "task-states")


LATE_SQL = """m AS (SELECT k, max(file_pos) AS pos FROM event_log WHERE kind = 'APPLICATION_INITED' GROUP BY k)
    SELECT k, file_pos, kind FROM event_log JOIN m USING (k) WHERE kind NOT LIKE 'TASK%' OR file_pos > pos"""


@query("T10_late_events", LATE_SQL, ("event_log",))
def late_events(t: Tables):
    """The log is closed by an event of no application, so that the watermark passes all events before it."""
    log = t.event_log
    after = F.max("ts_ms") + ATTEMPT_MS + DELAY_MS + 1000
    end = log.agg(after.alias("ts_ms")).where("ts_ms IS NOT NULL").select(
        *("ts_ms" if c == "ts_ms" else F.lit(None).cast(kind).alias(c) for c, kind in log.dtypes))
    passed = liveness.current_events(_stream(t, log, "event-log", last=end, bounded=True), ATTEMPT_MS, DELAY)
    return drain(passed, label="current-events").where("k IS NOT NULL").select("k", "file_pos", "kind")


@query(
    "T11_changes",
    """SELECT task, id, ts_ms, kind FROM (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY task ORDER BY ts_ms, id) AS changed FROM pings) c WHERE changed""",
    ("pings",),
)
def changes(t: Tables):
    return drain(keyed.changed_snapshots(_stream(t, t.pings, "polls"), ["kind"]), label="changes", keyed=True)


RELEASE_SQL = f"""{REGISTER_SQL} SELECT k, max(reg_ms) AS release_ms FROM l GROUP BY k HAVING bool_and(registers)"""


@query("T12_gang_release_stream", RELEASE_SQL, ("tasks",))
def gang_release_stream(t: Tables):
    came = _launches(t).where(F.col("reg_ms").isNotNull()).select(
        "k", F.col("task_id").alias("task"), F.col("reg_ms").alias("ts_ms")
    )
    expected = t.tasks.groupBy("k").agg(F.count(F.lit(1)).alias("expected"))
    return state_of(states.gang_release(_stream(t, came, "registrations"), written(expected, "expected")), ["k"], "gangs")


@query("T12_gang_release", RELEASE_SQL, ("tasks",))
def gang_release(t: Tables):
    return tasks.gang_release(_launches(t), F.col("reg_ms"))


@query("T13_dependency_countdown_stream", ORACLES["W08_dependency_countdown"])
def dependency_countdown_stream(t: Tables):
    done = t.tasks.where(predicates.is_completed()).select("k", "role", "idx", F.col("end_ms").alias("ts_ms"))
    # Applications of one week share a state, in parts.
    week = t.apps.select("k", F.concat(F.floor(F.col("started_ms") / (7 * 86_400_000)), F.lit("/"), F.col("k") % 8).alias("bucket"))
    roles = tasks.role_summary(t.tasks).select("k", "role", "instances").join(week, "k", "left")
    instances = written(roles.withColumn("bucket", F.coalesce("bucket", F.lit(""))), "instances")
    return drain(keyed.dependency_countdown(_stream(t, done, "finishes"), instances, role_edges(t)), label="countdown", keyed=True)


@query(
    "T14_mover",
    """
    f AS (SELECT app_id, usr, CASE WHEN completed_ms = -1 AND k % 3 = 0 THEN 'KILLED' ELSE status END AS status,
                 CASE WHEN completed_ms = -1 AND k % 3 = 0 THEN 1767225600000 ELSE completed_ms END AS completed_ms FROM apps)
    SELECT app_id, usr, status, strftime(epoch_ms(completed_ms), '%Y') AS year, strftime(epoch_ms(completed_ms), '%m') AS month,
           strftime(epoch_ms(completed_ms), '%d') AS day FROM f WHERE completed_ms <> -1""",
    ("apps",),
)
def mover(t: Tables):
    status = F.when(F.col("completed_ms") != -1, F.col("status"))
    landing = t.apps.select(names.build_history_name("app_id", "started_ms", "completed_ms", "usr", status).alias("name"))
    killed = t.apps.where("k % 3 = 0").select("app_id")
    store = scratch_dir(t.spark, "finished")
    jobs.move_finished(_stored(t, landing, "landing"), killed, 1_767_225_600_000, store, f"{store}-index", f"{store}-state")
    layout = "app_id string, usr string, status string, day string, stream string, batch int, year string, month string"
    return t.spark.read.schema(layout).parquet(store).drop("stream", "batch")


HOURS_MS = 6 * 3_600_000
ROLLUP_SQL = f"""SELECT task, ts_ms // {HOURS_MS} * {HOURS_MS} AS start_ms, count(*) AS samples, max(value) AS max_value, round(avg(value), 9) AS avg_value
    FROM samples GROUP BY task, ts_ms // {HOURS_MS}"""


@query("T15_interval_rollup", ROLLUP_SQL, ("samples",))
def interval_rollup(t: Tables):
    return telemetry.interval_rollup(t.samples, HOURS_MS).withColumn("avg_value", F.round("avg_value", 9))


@query(
    "T15_interval_rollup_stream",
    f"{ROLLUP_SQL} HAVING ts_ms // {HOURS_MS} * {HOURS_MS} + {HOURS_MS} <= (SELECT max(ts_ms) - {DELAY_MS} FROM samples)",
    ("samples",),
)
def interval_rollup_stream(t: Tables):
    out = drain(liveness.interval_rollup(samples_of(_events(t)), "6 hours", DELAY), label="rollup")
    return out.withColumn("avg_value", F.round("avg_value", 9))


# Eleven reasons, each with the time at which it came true. Client stops and preprocessing are derived from the applications.
CLIENT_SQL = """
    said AS (SELECT k, started_ms + 600000 * (1 + k % 7) AS ts_ms, 'CLIENT_STOP' AS kind, 0 AS exit_code FROM apps WHERE k % 23 = 5
             UNION ALL SELECT k, started_ms + 60000, 'PREPROCESS_FINISHED', CAST(k % 2 AS INT) FROM apps WHERE k % 19 = 3)"""
SIGNALS_SQL = f"""{REGISTER_SQL}, {GROUPS_SQL}, {CLIENT_SQL},
    rt AS (SELECT t.*, NOT list_contains(r.off_roles, t.role) AS tracked, list_contains(r.stop_roles, t.role) AS stops, r.strict FROM tasks t JOIN app_rules r USING (k)),
    bad AS (SELECT DISTINCT a.k FROM app_edges a JOIN app_edges b ON a.k = b.k AND a.role = b.depends_on AND a.depends_on = b.role
            JOIN (SELECT DISTINCT k, role FROM tasks) x ON x.k = a.k AND x.role = a.role JOIN (SELECT DISTINCT k, role FROM tasks) y ON y.k = a.k AND y.role = a.depends_on),
    late AS (SELECT t.k, t.role, t.idx, t.exit_code, t.start_ms, t.end_ms, l.reg_ms, l.registers FROM tasks t JOIN l ON l.task_id = concat(t.k, '/', t.role, ':', t.idx)),
    sig AS (
        SELECT k, started_ms + 72000000 AS at_ms, 1 AS rank, 'timeout' AS reason FROM apps WHERE completed_ms = -1 OR completed_ms - started_ms > 72000000
        UNION ALL SELECT k, ts_ms, 2, 'client_stop' FROM said WHERE kind = 'CLIENT_STOP'
        UNION ALL SELECT k, end_ms, 3, 'training_finished' FROM rt WHERE role = 'evaluator' AND exit_code = 0
              OR exit_code NOT IN (0, -105) AND tracked AND (strict OR stops OR role = 'evaluator')
        UNION ALL SELECT k, ts_ms, 4, 'preprocess_failed' FROM said WHERE kind <> 'CLIENT_STOP' AND exit_code <> 0
        UNION ALL SELECT k, ts_ms, 5, 'single_node_finished' FROM said WHERE kind <> 'CLIENT_STOP' AND k % 3 = 0
        UNION ALL SELECT k, end_ms, 6, 'untracked_failed' FROM rt WHERE NOT tracked AND exit_code NOT IN (0, -105)
        UNION ALL SELECT k, started_ms, 7, 'bad_graph' FROM apps JOIN bad USING (k) WHERE k % 4 = 1
        UNION ALL SELECT k, at_ms, 8, 'unhealthy' FROM overdue WHERE outcome = 'FAILED'
        UNION ALL SELECT k, start_ms + {LIMIT_MS}, 9, 'registration_timeout' FROM late WHERE NOT (registers AND reg_ms - start_ms <= {LIMIT_MS})
        UNION ALL SELECT k, end_ms, 10, 'startup_failed' FROM late WHERE exit_code NOT IN (0, -105) AND NOT (registers AND reg_ms BETWEEN end_ms - 86400000 AND end_ms)
        UNION ALL SELECT k, max(end_ms), 11, 'all_tracked_done' FROM rt WHERE tracked GROUP BY k HAVING count(*) = count(exit_code))"""
REASON_SQL = f"""{SIGNALS_SQL}
    SELECT k, arg_min(reason, (at_ms, rank)) AS reason, min(at_ms) AS at_ms FROM sig GROUP BY k"""
REASON_VIEWS = ("apps", "tasks", "app_rules", "app_edges", "app_members", "app_group_rules")


def signals(t: Tables) -> DataFrame:
    """k, at_ms, reason of everything that can end an application, by its own settings.

    Tasks are built once and each kind of signal is written out before the next is looked for, so that what is shuffled for
    one is gone by then.
    """
    t.write_once("tasks")
    k = F.col("k")
    stops = t.apps.where("k % 23 = 5").select(
        "k", (F.col("started_ms") + 600_000 * (1 + k % 7)).alias("ts_ms"), F.lit("").alias("role"), F.lit(states.CLIENT_STOP).alias("kind"), F.lit(0).alias("exit_code"))
    prepared = t.apps.where("k % 19 = 3").select(
        "k", (F.col("started_ms") + 60_000).alias("ts_ms"), F.lit("").alias("role"), F.lit(states.PREPROCESSED).alias("kind"), (k % 2).cast("int").alias("exit_code"))
    launches, log = _launches(t), t.event_log
    present = tasks.role_summary(t.tasks).select("k", "role", "instances")
    sound = graph.acyclic(present.select(k.alias("app"), "role"), t.app_edges.withColumnRenamed("k", "app")).where("NOT acyclic")
    starts = _starts(t)
    begun = starts.select("k", "ts_ms", F.lit("").alias("role"), F.lit("APPLICATION_INITED").alias("kind"), F.lit(None).cast("int").alias("exit_code"))
    events = log.where("kind = 'TASK_FINISHED'").select(*stops.columns)  # of a task only its end says anything
    events = events.unionByName(begun).unionByName(stops).unionByName(prepared)
    ruled = rules.with_rules(events, t.job_settings, hot=t.hot_apps).join(sound.select(F.col("app").alias("k"), (F.col("app") % 4 == 1).alias("bad_graph")), "k", "left")
    ruled = ruled.withColumns({"bad_graph": F.coalesce("bad_graph", F.lit(False)), "single_node": k % 3 == 0})
    ends = log.where("kind = 'APPLICATION_FINISHED'")
    named = lambda rows, at, reason: rows.select("k", at.alias("at_ms"), F.lit(reason).alias("reason"))
    ts = F.col("ts_ms")
    roles_of = launched_tasks(t).select("k", "role", "idx", "start_ms", "end_ms", "exit_code", "host")
    came = roles_of.where("host IS NOT NULL").select("k", "role", "idx", (F.col("start_ms") + k % 40 * 60_000).alias("ts_ms"))
    failures = roles_of.where(predicates.is_failed()).select("k", "role", "idx", F.col("end_ms").alias("ts_ms"))
    tracked = rules.with_rules(t.tasks, t.job_settings, hot=t.hot_apps).where("tracked")
    waiting = tasks.overdue_at(present, t.tasks, t.app_group_rules, t.app_members)
    found = [
        named(liveness.app_timeouts(starts, ends, 72_000_000, DELAY), ts + 72_000_000, "timeout"),
        states.event_signals(ruled, chief_role="evaluator"),
        named(waiting.where("outcome = 'FAILED'"), F.col("at_ms"), "unhealthy"),
        named(liveness.unanswered(launches.select("task_id", "k", "ts_ms"), launches.where("reg_ms IS NOT NULL").select("task_id", F.col("reg_ms").alias("ts_ms")), ["task_id"], LIMIT_MS, DELAY), ts + LIMIT_MS, "registration_timeout"),
        named(liveness.failed_before_registering(failures, came, 86_400_000, DELAY), ts, "startup_failed"),
        named(tasks.all_ended(tracked), F.col("at_ms"), "all_tracked_done"),
    ]
    every = None
    for rows in found:
        rows = written(rows, "signal")
        every = rows if every is None else every.unionByName(rows)
    return every


@query("T16_reason_by_settings", REASON_SQL, REASON_VIEWS)
def reason_by_settings(t: Tables):
    return states.first_reason(signals(t))


@query("T16_termination_reason_stream", REASON_SQL, REASON_VIEWS)
def termination_reason_stream(t: Tables):
    """The same signals as they come true, merged as a stream."""
    return state_of(states.first_reason(_stream(t, signals(t), "signals", by="at_ms")), ["k"], "reasons")


@query(
    "T17_untracked_failure_stream",
    """SELECT k, coalesce(bool_or(kind = 'TASK_FINISHED' AND role = 'ps' AND exit_code NOT IN (0, -105)), false) AS untracked_failed,
        min(ts_ms) FILTER (kind = 'TASK_FINISHED' AND role = 'ps' AND exit_code NOT IN (0, -105)) AS at_ms FROM event_log GROUP BY k""",
    ("event_log",),
)
def untracked_failure_stream(t: Tables):
    return state_of(states.untracked_failures(_log(t), predicates.is_untracked("role", UNTRACKED)), ["k"], "untracked")
