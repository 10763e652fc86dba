"""Streams cut into several micro-batches give what the batch forms give."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from runledger.operators import history, tasks, telemetry
from runledger.plans.catalog import QUERIES
from runledger.plans.tables import Tables
from runledger.streaming import jobs, keyed, liveness, states
from runledger.streaming.running import SETTINGS, changes_of, changes_to, drain, for_each_batch, newest, stream_of

SF_DIR = f"{DATA}/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def chunked(spark, tmp_path, df, order, n=4):
    """A stream giving ``df`` in ``order``, one of ``n`` files per micro-batch."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    path = str(tmp_path / "in")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return stream_of(spark, path, df.schema, files_per_batch=1)


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.range(400).select(
        (F.col("id") % 7).alias("task"), "id", (F.col("id") * 1000 + F.col("id") % 5).alias("ts_ms"),
        F.when(F.col("id") % 4 != 1, (F.col("id") % 11).cast("double")).alias("value"),
    )
    return rows


@pytest.fixture(scope="module")
def pings(samples):
    kind = F.when(F.col("id") % 13 == 0, "register").when(F.col("id") % 29 == 0, "result").otherwise("ping")
    gap = F.when(F.col("id") > 200, 60_000).otherwise(0)
    return samples.select("task", "id", (F.col("ts_ms") + gap).alias("ts_ms"), kind.alias("kind"))


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for k in range(6):
        rows.append((k, 0, "APPLICATION_INITED", "", -1, None))
        rows += [(k, 10 + i, "TASK_STARTED", "worker" if i % 2 else "ps", i, None) for i in range(4)]
        if k % 2:
            rows.append((k, 20, "APPLICATION_INITED", "", -1, None))
            rows += [(k, 30 + i, "TASK_STARTED", "worker" if i % 2 else "ps", i, None) for i in range(4)]
        rows += [(k, 50 + i, "TASK_FINISHED", "worker" if i % 2 else "ps", i, (k + i) % 2) for i in range(3)]
    seen, out = {}, []
    for k, ts, kind, role, idx, code in rows:
        pos = seen.get(k, 0)
        seen[k] = pos + 1
        out.append((k, ts, kind, role, idx, "h", code, pos))
    return spark.createDataFrame(
        out, "k int, ts_ms long, kind string, role string, idx int, host string, exit_code int, file_pos long")


def final(stream, keys, tmp_path, label="out", keyed=False):
    """The state after the stream, and the rows that each batch gave."""
    path = str(tmp_path / label)
    changes_to(stream, path, f"{path}-state", keyed=keyed)
    rows = changes_of(stream.sparkSession, path, stream.schema)
    return newest(rows, keys), {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def near(df):
    return rows_of(df.withColumn("avg_value", F.round("avg_value", 9)).select("task", "refreshes", "avg_value", "max_value", "ts_ms", "value"))


def test_metric_state(spark, tmp_path, samples):
    got, by_batch = final(keyed.metric_state(chunked(spark, tmp_path, samples, ["ts_ms"])), ["task"], tmp_path, keyed=True)
    want = (
        telemetry.running_average(samples)
        .join(telemetry.running_maximum(samples), "task")
        .join(telemetry.latest(samples), "task")
    )
    assert near(got) == near(want)
    assert by_batch == {0: 7, 1: 7, 2: 7, 3: 7}  # rows come out with every batch


def test_metric_state_resumes(spark, tmp_path, samples):
    """Stopped after half of the input, and started anew: the state goes on."""
    rows, path, out = samples.orderBy("ts_ms").collect(), str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:211], rows[211:]):
        feed(spark, path, part, samples.schema)
        changes_to(keyed.metric_state(stream_of(spark, path, samples.schema)), out, f"{out}-state", keyed=True)
    stream = keyed.metric_state(stream_of(spark, path, samples.schema))
    got = newest(changes_of(spark, out, stream.schema), ["task"])
    want = telemetry.running_average(samples).join(telemetry.running_maximum(samples), "task").join(telemetry.latest(samples), "task")
    assert near(got) == near(want)


def test_changes(spark, tmp_path, pings):
    want = telemetry.changed_snapshots(pings, ["kind"]).where("changed").drop("changed")
    got = drain(keyed.changed_snapshots(chunked(spark, tmp_path, pings, ["ts_ms"]), ["kind"]), keyed=True)
    assert rows_of(got) == rows_of(want)
    two = pings.withColumns({"level": F.when(F.col("id") % 3 > 0, F.col("id") % 2), "x": F.lit("y")})
    want = telemetry.changed_snapshots(two, ["kind", "level"]).where("changed").drop("changed", "x")
    assert rows_of(drain(keyed.changed_snapshots(chunked(spark, tmp_path / "two", two, ["ts_ms"]), ["kind", "level"]), keyed=True)) == rows_of(want)


def test_task_states(spark, tmp_path, log):
    for label, order in (("time", ["ts_ms", "k"]), ("mixed", [F.xxhash64("k", "file_pos")])):
        got, _ = final(states.task_states(chunked(spark, tmp_path / label, log, order)), ["k", "role", "idx"], tmp_path, label + "-out")
        assert rows_of(got) == rows_of(tasks.first_terminal_status(log).drop("exit_code"))


def test_current_events_in_any_order(spark, tmp_path, log):
    """Shuffled input gives the batch answer, for all events that the watermark passes."""
    last = [(99, 1_000_000, "APPLICATION_INITED", "", -1, "h", None, 0)]
    path = str(tmp_path / "in")
    log = log.withColumn("ts_ms", F.col("ts_ms") + 1000)  # a watermark starts at 0
    rows = log.orderBy(F.xxhash64("k", "file_pos")).collect()
    for part in (rows[::3], rows[1::3], rows[2::3], last):
        feed(spark, path, part, log.schema)
    got = drain(keyed.current_events(stream_of(spark, path, log.schema, files_per_batch=1), "100 seconds"), keyed=True)
    assert rows_of(got) == rows_of(history.current_attempt(log).drop("attempt", "session_id"))


def test_current_events_are_judged_at_the_watermark(spark, tmp_path, log):
    """An event passes if no newer attempt has begun when the watermark passes it; one that comes later does not."""
    rows = log.where("k = 1").withColumn("ts_ms", F.col("ts_ms") + 1000).orderBy("file_pos").collect()
    first, second = [r for r in rows if r["ts_ms"] < 1020], [r for r in rows if r["ts_ms"] >= 1020]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    other = lambda ts: (99, ts, "APPLICATION_INITED", "", -1, "h", None, 0)
    for part in ([*first[:4], other(1016)], [*second, *first[4:]], [other(1500)]):
        feed(spark, path, part, log.schema)
        stream = keyed.current_events(stream_of(spark, path, log.schema), "4 milliseconds")
        changes_to(stream, out, f"{out}-state", "append", keyed=True)
    got = changes_of(spark, out, log.schema)
    passed = {r["file_pos"] for r in first[:4] if r["ts_ms"] < 1012}
    assert len(passed) == 3  # the fourth was still held, the fifth came late
    assert {r["file_pos"] for r in got.where("k = 1").collect()} == passed | {r["file_pos"] for r in second}


def test_current_events_wait_for_newer_attempts(spark, tmp_path, log):
    """The native form: the batch answer in any order, events of the last hour too once the log is closed."""
    rows = log.withColumn("ts_ms", F.col("ts_ms") + 1000).orderBy(F.xxhash64("k", "file_pos")).collect()
    path = str(tmp_path / "in")
    for part in (rows[::3], rows[1::3], rows[2::3], [(None, 1_000_000, None, "", -1, "h", None, 0)]):
        feed(spark, path, part, log.schema)
    got = drain(liveness.current_events(stream_of(spark, path, log.schema, files_per_batch=1), 100_000, "100 seconds"))
    want = history.current_attempt(log.withColumn("ts_ms", F.col("ts_ms") + 1000)).drop("attempt", "session_id")
    assert rows_of(got.where("k IS NOT NULL").drop("ts_ms")) == rows_of(want.drop("ts_ms"))


def test_large_tables_come_in_more_batches(spark, tmp_path, monkeypatch):
    """Of a table beyond four batches of a file a core, each batch holds the next in time, and no row comes late or twice."""
    from runledger.plans import streams

    rows = spark.range(900).select((F.col("id") * 7919 % 900 * 1000).alias("ts_ms"), "id").withColumn("ts_ms", F.when(F.col("id") != 5, F.col("ts_ms")))
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    stream = streams._stream(Tables(spark, SF_DIR), rows, "many", bounded=True)
    changes_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = changes_of(spark, str(tmp_path / "out"), stream.schema)
    assert rows_of(got.select("id")) == rows_of(rows.select("id"))
    spans = got.groupBy("batch").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
    assert len(spans) > streams.BATCHES and max(r["n"] for r in spans) < 200 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    monkeypatch.setattr(streams, "FILE_ROWS", 400)
    late, log = QUERIES["T10_late_events"](spark, SF_DIR), Tables(spark, SF_DIR).event_log
    assert rows_of(late) == rows_of(history.current_attempt(log).select("k", "file_pos", "kind"))


def test_late_events_has_the_last_hour(spark):
    t = Tables(spark, SF_DIR)
    want = history.current_attempt(t.event_log).select("k", "file_pos", "kind")
    assert rows_of(QUERIES["T10_late_events"](spark, SF_DIR)) == rows_of(want)
    assert t.event_log.where(F.col("ts_ms") >= t.event_log.agg(F.max("ts_ms")).first()[0] - 3_600_000).count() > 0


def test_countdown(spark, tmp_path, log):
    done = log.where("kind = 'TASK_FINISHED'").select("k", "role", "idx", "ts_ms")
    rows = log.where("kind = 'TASK_FINISHED'").select(
        "k", "role", "idx", F.lit("h").alias("host"), F.lit(0).alias("start_ms"), F.col("ts_ms").alias("end_ms"), "exit_code")
    edges = spark.createDataFrame([("worker", "ps"), ("ps", "worker")], "role string, depends_on string")
    instances = tasks.role_summary(rows).select("k", "role", "instances")
    path = str(tmp_path / "out")
    stream = states.dependency_countdown(chunked(spark, tmp_path, done, ["ts_ms", "k"]), instances, edges)
    changes_to(stream, path, f"{path}-state")
    got = changes_of(spark, path, stream.schema)
    each = tasks.dependency_countdown(rows, edges).select("k", "role", "depends_on", "left", "ready", "at_ms")
    assert set(rows_of(got.drop("stream", "batch"))) <= set(rows_of(each))
    assert rows_of(got.where("ready").drop("stream", "batch")) == rows_of(each.where("ready"))  # ready once
    assert got.select("batch").distinct().count() > 1


def test_countdown_after_each_finish(spark, tmp_path, log):
    rows = log.where("kind = 'TASK_FINISHED'").select(
        "k", "role", "idx", F.lit("h").alias("host"), F.lit(0).alias("start_ms"), F.col("ts_ms").alias("end_ms"), "exit_code")
    open_task = spark.createDataFrame([(3, "ps", 9, "h", 0, None, None)], rows.schema)
    rows = rows.unionByName(open_task)
    edges = spark.createDataFrame([("worker", "ps"), ("ps", "worker")], "role string, depends_on string")
    instances = tasks.role_summary(rows).select("k", "role", "instances")
    done = rows.where("exit_code IS NOT NULL").select("k", "role", "idx", F.col("end_ms").alias("ts_ms"))
    want = rows_of(tasks.dependency_countdown(rows, edges))
    for label, roles in (("apps", instances), ("buckets", instances.withColumn("bucket", F.col("k") % 2))):
        stream = chunked(spark, tmp_path / label, done, ["ts_ms", "k"])
        assert rows_of(drain(keyed.dependency_countdown(stream, roles, edges), keyed=True)) == want


def test_countdown_stream_has_every_finish(spark):
    want = QUERIES["W08_dependency_countdown"](spark, SF_DIR)
    assert rows_of(QUERIES["T13_dependency_countdown_stream"](spark, SF_DIR)) == rows_of(want)


def test_gang_release(spark, tmp_path):
    calls = [(1, "a", 5), (1, "b", 9), (2, "a", 4), (1, "c", 7), (2, "a", 6), (1, "a", 30), (3, "a", 8)]  # two tasks register again
    rows = spark.createDataFrame(calls, "k int, task string, ts_ms long")
    expected = spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "k int, expected long")
    got, by_batch = final(states.gang_release(chunked(spark, tmp_path, rows, ["ts_ms"]), expected), ["k"], tmp_path)
    assert {(r["k"], r["release_ms"]) for r in got.collect()} == {(1, 9), (3, 8)} and sum(by_batch.values()) == 2


def test_group_timeouts_fire_and_arm_again(spark, tmp_path):
    """Group A (worker) ends at 10 s, then anew at 40 s as a second worker ends; the evaluator may run 20 s beyond."""
    schema = "k int, ts_ms long, kind string, role string, idx int"
    end = lambda k, s, role, idx: (k, s * 1000, "TASK_FINISHED", role, idx)
    steps = [
        [end(1, 10, "worker", 0), end(2, 10, "worker", 0), end(3, 10, "worker", 0), end(4, 10, "worker", 0)],
        [end(1, 40, "worker", 1), end(2, 40, "worker", 1), end(3, 35, "worker", 1), end(3, 50, "evaluator", 0), (9, 50_000, "TASK_FINISHED", "x", 0)],
        [end(2, 65, "evaluator", 0), (9, 62_000, "TASK_FINISHED", "x", 0)],
        [(9, 80_000, "TASK_FINISHED", "x", 0)],
    ]
    plan = [(k, role, n) for k in (1, 2, 3, 4) for role, n in (("worker", 2), ("evaluator", 1))]
    roles = spark.createDataFrame(plan, "k int, role string, instances long")
    rules = spark.createDataFrame([("evaluator", "A", 20, False), ("evaluator", "0", 1, True)], "role string, grp string, timeout_s int, ignored boolean")
    members = spark.createDataFrame([("A", "worker"), ("A", "absent")], "grp string, role string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for part in steps:
        feed(spark, path, part, schema)
        stream = keyed.group_timeouts(stream_of(spark, path, spark.createDataFrame([], schema).schema), keyed.watched(roles, rules, members), "1 second")
        changes_to(stream, out, f"{out}-state", "append", keyed=True)
        seen.append({tuple(r)[:5] for r in changes_of(spark, out, stream.schema).collect()})
    late = {(k, "evaluator", "A", "FAILED", 60_000) for k in (1, 2)}  # both ran at 60 s; 3 ended at 50 s, 4's group is not done
    assert seen == [set(), set(), late, late]


def test_a_bucket_has_one_timer():
    """However many applications wait in it; what is due comes out at once, and the next time is set."""
    import json
    from types import SimpleNamespace

    timers, kept = set(), []
    state = SimpleNamespace(get=lambda: kept[-1] if kept else None, update=kept.append)
    each = keyed.GroupTimeouts()
    each.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove))
    watch = json.dumps({
        "roles": [{"role": "worker", "instances": 1}, {"role": "evaluator", "instances": 1}], "members": [{"grp": "A", "role": "worker"}],
        "rules": [{"role": "evaluator", "grp": "A", "timeout_s": 1, "ignored": False}]})
    end = lambda k, ts: SimpleNamespace(k=k, role="worker", ts_ms=ts, watch=watch)
    list(each.handleInputRows(("b",), [end(k, 1000 * k) for k in range(5, 25)], None))
    assert timers == {6001}
    list(each.handleInputRows(("b",), [end(k, 1000 * k) for k in range(2, 5)], None))
    assert timers == {3001}
    due = lambda now: (timers.clear(), sorted(r.k for r in each.handleExpiredTimer(("b",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)))[1]
    assert due(12_500) == list(range(2, 12)) and timers == {13_001}
    assert due(90_000) == list(range(12, 25)) and timers == set()


def test_unanswered_comes_out_as_the_limit_passes(spark, tmp_path):
    """The row is there after the batch whose watermark passes the limit, while the stream goes on."""
    schema, out = spark.createDataFrame([], "k int, ts_ms long").schema, str(tmp_path / "out")
    starts, ends, seen = str(tmp_path / "starts"), str(tmp_path / "ends"), []
    for s, e in (([(1, 1), (2, 1), (9, 1_000)], [(9, 1_000)]), ([(9, 9_000)], [(2, 5_000), (9, 9_000)]), ([(9, 30_000)], [(9, 30_000)]), ([(9, 40_000)], [(1, 39_000)])):
        feed(spark, starts, s, schema)
        feed(spark, ends, e, schema)
        stream = liveness.app_timeouts(stream_of(spark, starts, schema), stream_of(spark, ends, schema), 10_000, "1 second")
        changes_to(stream, out, f"{out}-state", "append")
        seen.append({r["k"] for r in changes_of(spark, out, stream.schema).collect()} - {9})
    assert seen == [set(), set(), {1}, {1}]


def test_joined_streams_keep_their_rows_on_disk(spark, tmp_path):
    """State of a stream join lies in the store with files, not in the heap of the executors."""
    from pathlib import Path

    schema = spark.createDataFrame([], "k int, ts_ms long").schema
    for side, rows in (("starts", [(1, 1), (2, 1), (9, 90_000)]), ("ends", [(2, 5_000), (9, 90_000)])):
        feed(spark, str(tmp_path / side), rows, schema)
    stream = liveness.app_timeouts(stream_of(spark, str(tmp_path / "starts"), schema), stream_of(spark, str(tmp_path / "ends"), schema), 10_000, "1 second")
    assert [tuple(r) for r in drain(stream, label="joined-test", joined=True).collect()] == [(1, 1)]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    state = [f for at in folder.glob("joined-test-*-state") for f in (at / "state").rglob("*")]
    assert any(f.suffix == ".changelog" for f in state) and not any(f.suffix in (".delta", ".snapshot") for f in state)


def test_starts_begin_their_logs(spark):
    """The first of a log by time, an application's event before a task's; no time comes before any."""
    from types import SimpleNamespace

    from runledger.plans.streams import _starts

    init, task = "APPLICATION_INITED", "TASK_STARTED"
    log = [(1, 10, init), (1, 10, task), (1, 20, init), (2, 10, init), (2, 9, task), (3, 10, init), (3, None, task), (4, None, init), (4, None, task), (5, 7, init), (5, 7, init), (6, -3, init)]
    rows = spark.createDataFrame(log, "k int, ts_ms long, kind string")
    assert sorted(map(str, (tuple(r) for r in _starts(SimpleNamespace(event_log=rows)).collect()))) == ["(1, 10)", "(4, None)", "(5, 7)", "(6, -3)"]


def test_first_reason(spark, tmp_path):
    rows = [(1, 50, "client_stop"), (1, 20, "all_tracked_done"), (1, 20, "unhealthy"), (2, 9, "timeout"), (2, 8, "startup_failed"), (3, 1, "bad_graph")]
    signals = spark.createDataFrame(rows, "k int, at_ms long, reason string")
    want = {(1, "unhealthy", 20), (2, "startup_failed", 8), (3, "bad_graph", 1)}
    assert {tuple(r) for r in states.first_reason(signals).collect()} == want
    got, _ = final(states.first_reason(chunked(spark, tmp_path, signals, [F.desc("at_ms")])), ["k"], tmp_path)
    assert {tuple(r) for r in got.collect()} == want


def test_signals_read_what_is_written(spark):
    """Each kind of signal is a table of its own, built on tasks that were written once: no shuffle is left behind it."""
    from runledger.plans.streams import signals

    t = Tables(spark, SF_DIR)
    plan = signals(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6 and "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    assert "Join" not in t.tasks._jdf.queryExecution().optimizedPlan().toString()


def test_event_signals(spark):
    rows = [
        (1, 1, "APPLICATION_INITED", "", None, True, False, False, False, True), (1, 2, "PREPROCESS_FINISHED", "", 3, True, False, False, True, False),
        (2, 3, "CLIENT_STOP", "", None, True, False, False, False, False), (2, 4, "TASK_FINISHED", "chief", 0, True, False, False, False, False),
        (3, 5, "TASK_FINISHED", "worker", 1, True, False, False, False, False), (3, 6, "TASK_FINISHED", "worker", 1, True, True, False, False, False),
        (3, 7, "TASK_FINISHED", "worker", 1, True, False, True, False, False), (3, 8, "TASK_FINISHED", "ps", 1, False, True, True, False, False),
        (3, 9, "TASK_FINISHED", "chief", -105, True, True, True, False, False),
    ]
    schema = "k int, ts_ms long, kind string, role string, exit_code int, tracked boolean, stops boolean, strict boolean, single_node boolean, bad_graph boolean"
    got = {(r["at_ms"], r["reason"]) for r in states.event_signals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "bad_graph"), (2, "preprocess_failed"), (2, "single_node_finished"), (3, "client_stop"), (4, "training_finished"),
                   (6, "training_finished"), (7, "training_finished"), (8, "untracked_failed")}


def test_ingest_goes_on_and_keeps_what_others_wrote(spark, tmp_path, log):
    rows, source, path = log.orderBy("ts_ms", "k").collect(), str(tmp_path / "in"), str(tmp_path / "log")
    first, check = str(tmp_path / "a"), str(tmp_path / "b")
    count = lambda: spark.read.parquet(path).count()
    feed(spark, source, rows[:10], log.schema)
    jobs.ingest_events(stream_of(spark, source, log.schema), path, first)
    assert count() == 10
    feed(spark, source, rows[10:15], log.schema)
    jobs.ingest_events(stream_of(spark, source, log.schema), path, first)
    assert count() == 15  # the second call goes on
    jobs.ingest_events(stream_of(spark, source, log.schema), path, first)
    assert count() == 15
    feed(spark, str(tmp_path / "other"), rows[15:18], log.schema)
    jobs.ingest_events(stream_of(spark, str(tmp_path / "other"), log.schema), path, check)
    assert count() == 18  # another stream into the same log
    got = spark.read.parquet(path).select(*log.columns)
    assert rows_of(got) == sorted(map(str, spark.createDataFrame(rows[:18], log.schema).select(*sorted(log.columns)).collect()))


def test_a_killed_batch_comes_once(spark, tmp_path, log):
    rows, source, path, check = log.orderBy("ts_ms", "k").collect(), str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")
    feed(spark, source, rows[:12], log.schema)
    written, failed = [], []

    def step(batch, stream_id, n):
        batch.write.mode("overwrite").parquet(f"{path}/stream={stream_id}/batch={n}")
        written.append(n)
        if not failed:
            failed.append(n)
            raise RuntimeError("killed after the write")

    with pytest.raises(Exception, match="killed after the write"):
        for_each_batch(stream_of(spark, source, log.schema), step, check)
    for_each_batch(stream_of(spark, source, log.schema), step, check)
    assert written == [0, 0] and spark.read.parquet(path).count() == 12


def test_mover_goes_on(spark, tmp_path):
    names = [("application_1_1-100-200-ann-SUCCEEDED.jhist",), ("application_1_2-100-ann.jhist.inprogress",), ("application_1_3-100-ann.jhist.inprogress",)]
    source, store, index, check = (str(tmp_path / d) for d in ("in", "store", "index", "state"))
    killed = spark.createDataFrame([("application_1_3",)], "app_id string")
    move = lambda: jobs.move_finished(stream_of(spark, source, spark.createDataFrame([], "name string").schema), killed, 500, store, index, check)
    feed(spark, source, names[:2], "name string")
    assert {(r["app_id"], r["completed_ms"]) for r in move().collect()} == {("application_1_1", 200), ("application_1_2", -1)}
    feed(spark, source, [*names[2:], ("application_1_2-100-300-ann-FAILED.jhist",)], "name string")
    seen = {(r["app_id"], r["completed_ms"], r["status"]) for r in move().collect()}
    assert seen == {("application_1_1", 200, "SUCCEEDED"), ("application_1_2", 300, "FAILED"), ("application_1_3", 500, "KILLED")}
    assert spark.read.parquet(store).count() == 3


def test_sessions_over_batches(spark, tmp_path, pings):
    stream = chunked(spark, tmp_path, pings, ["ts_ms"])
    got = drain(liveness.liveness_sessions(stream, 20_000, "1 second"))
    newest = pings.agg(F.max("ts_ms")).first()[0]
    want = telemetry.liveness_sessions(pings, 20_000).drop("session").where(F.col("last_ms") + 20_001 <= newest - 1000)
    assert rows_of(got) == rows_of(want) and got.count() > 0


def test_settings_are_put_back(spark, tmp_path, pings):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    drain(liveness.liveness_sessions(chunked(spark, tmp_path, pings, ["ts_ms"], n=1), 20_000, "1 second"))
    assert {k: spark.conf.get(k, None) for k in SETTINGS} == before
