"""Application history: events, attempts, task life cycles, roll-ups and application lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.links import log_link
from runledger.functions.names import parse_history_name
from runledger.functions.predicates import is_failed, task_status
from runledger.operators.series import Series
from runledger.operators.skew import dim_join

INITED, FINISHED = "APPLICATION_INITED", "APPLICATION_FINISHED"
TASK_STARTED, TASK_FINISHED = "TASK_STARTED", "TASK_FINISHED"
METRICS = "array<struct<name:string,value:double>>"


def to_event_union(events: DataFrame) -> DataFrame:
    """Event rows as one nullable struct per event type, the layout of the stored log."""
    kind = F.col("kind")
    app_id = F.concat(F.lit("application_"), F.col("k").cast("string"))
    none = lambda t: F.lit(None).cast(t)
    branch = lambda name, *fields: F.when(kind == name, F.struct(*fields))
    return events.select(
        "k",
        "file_pos",
        F.struct(
            kind.alias("type"),
            branch(
                INITED, app_id.alias("application_id"), none("int").alias("num_tasks"), F.col("host"),
                none("string").alias("container_id"),
            ).alias("app_inited"),
            branch(
                FINISHED, app_id.alias("application_id"), none("int").alias("finished_tasks"),
                none("int").alias("failed_tasks"), none(METRICS).alias("metrics"),
            ).alias("app_finished"),
            branch(
                TASK_STARTED, F.col("role").alias("task_type"), F.col("idx").alias("task_index"), F.col("host"),
                none("string").alias("container_id"),
            ).alias("task_started"),
            branch(
                TASK_FINISHED, F.col("role").alias("task_type"), F.col("idx").alias("task_index"),
                task_status("exit_code").alias("status"), none(METRICS).alias("metrics"),
                none("string").alias("diagnostic"),
            ).alias("task_finished"),
            F.col("ts_ms").alias("timestamp"),
        ).alias("e"),
    )


def flatten_events(events: DataFrame, event: str = "e") -> DataFrame:
    """(type, payload fields, timestamp) of a union-of-structs event, one wide row each."""
    first = lambda *paths: F.coalesce(*(F.col(f"{event}.{p}") for p in paths))
    return events.select(
        *(c for c in events.columns if c != event),
        F.col(f"{event}.type").alias("type"),
        first("app_inited.application_id", "app_finished.application_id").alias("application_id"),
        F.col(f"{event}.app_inited.num_tasks").alias("num_tasks"),
        F.col(f"{event}.app_finished.finished_tasks").alias("finished_tasks"),
        F.col(f"{event}.app_finished.failed_tasks").alias("failed_tasks"),
        first("task_started.task_type", "task_finished.task_type").alias("task_type"),
        first("task_started.task_index", "task_finished.task_index").alias("task_index"),
        first("app_inited.host", "task_started.host").alias("host"),
        first("app_inited.container_id", "task_started.container_id").alias("container_id"),
        F.col(f"{event}.task_finished.status").alias("status"),
        first("app_finished.metrics", "task_finished.metrics").alias("metrics"),
        F.col(f"{event}.task_finished.diagnostic").alias("diagnostic"),
        F.col(f"{event}.timestamp").alias("timestamp"),
    )


def container_rows(events: DataFrame) -> DataFrame:
    """``host`` and ``container`` kept for the two event types that carry them, null for others."""
    carries = F.col("kind").isin(INITED, TASK_STARTED)
    return events.withColumns({c: F.when(carries, F.col(c)) for c in ("host", "container")})


def container_links(
    events: DataFrame, users: DataFrame, node_address: str | None, hot: list | None = None
) -> DataFrame:
    """Container log links of all events that have a container; ``NA`` for an unknown user."""
    rows = container_rows(events).where(F.col("container").isNotNull())
    address = None if node_address is None else F.lit(node_address)
    return dim_join(rows, users.select("k", "usr"), "k", "left", hot).withColumn(
        "link", log_link("host", "container", "usr", address)
    )


def attempts(events: DataFrame, hot: bool | None = None) -> DataFrame:
    """Attempt number of every event (1-based) and its session id."""
    started = F.when(F.col("kind") == INITED, 1).otherwise(0).cast("long")
    return (
        Series(events, ["k"], ["file_pos"], hot)
        .running(attempt=started)
        .df.withColumn("session_id", F.col("attempt") - 1)
    )


def current_attempt(events: DataFrame, hot: list | None = None) -> DataFrame:
    """Events without those task events that belong to a past attempt."""
    last = events.groupBy("k").agg(F.count_if(F.col("kind") == INITED).alias("last_attempt"))
    numbered = attempts(events, None if hot is None else bool(hot))
    is_task = F.col("kind").isin(TASK_STARTED, TASK_FINISHED)
    return (
        dim_join(numbered, last, "k", "inner", hot)
        .where(~is_task | (F.col("attempt") == F.col("last_attempt")))
        .drop("last_attempt")
    )


def task_lifecycles(events: DataFrame, hot: bool | None = None) -> DataFrame:
    """One row per started task of an attempt: start, end, duration and status.

    The two events of a task meet in one aggregate, so partial results shuffle, not a join.
    """
    started, finished = F.col("kind") == TASK_STARTED, F.col("kind") == TASK_FINISHED
    return (
        attempts(events.where(F.col("kind") != FINISHED), hot)
        .where(started | finished)
        .groupBy("k", "attempt", "role", "idx")
        .agg(
            F.min(F.when(started, F.col("ts_ms"))).alias("start_ms"),
            F.min(F.when(finished, F.col("ts_ms"))).alias("end_ms"),
            F.min_by(F.when(finished, F.col("exit_code")), F.when(finished, F.col("ts_ms"))).alias("exit_code"),
        )
        .where(F.col("start_ms").isNotNull())
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .withColumn("status", task_status("exit_code"))
    )


def app_rollup(events: DataFrame, strict: bool = False) -> DataFrame:
    """Start, end, duration, task counts and status of each application, in one aggregate."""
    kind, ts = F.col("kind"), F.col("ts_ms")
    done = kind == TASK_FINISHED
    failed = done & is_failed("exit_code")
    out = events.groupBy("k").agg(
        F.min(F.when(kind == INITED, ts)).alias("start_ms"),
        F.coalesce(F.max(F.when(kind == FINISHED, ts)), F.lit(-1).cast("long")).alias("end_ms"),
        F.count_if(done).alias("finished_tasks"),
        F.count_if(failed).alias("failed_tasks"),
        F.count_if(kind == INITED).alias("attempts"),
    )
    open_ = F.col("end_ms") == -1
    bad = F.col("failed_tasks") > 0
    if not strict:
        bad = bad & (F.col("failed_tasks") >= F.col("finished_tasks"))
    return out.withColumn("duration_ms", F.when(~open_, F.col("end_ms") - F.col("start_ms"))).withColumn(
        "status", F.when(open_, "RUNNING").when(bad, "FAILED").otherwise("SUCCEEDED")
    )


def newest_history_file(files: DataFrame) -> DataFrame:
    """Per application the history file with the latest start time; the greater name on ties."""
    meta = parse_history_name("name")
    return (
        files.withColumn("app_id", meta["app_id"])
        .groupBy("app_id")
        .agg(F.max(F.struct(meta["started_ms"].alias("started_ms"), F.col("name"))).alias("f"))
        .select("app_id", "f.started_ms", "f.name")
    )


def merge_app_lists(key: str, *lists: DataFrame) -> DataFrame:
    """All lists as one, one row per ``key``; rows of a later list win."""
    columns = [c for c in lists[0].columns if c != key]
    every = None
    for order, rows in enumerate(lists):
        rows = rows.withColumn("_order", F.lit(order))
        every = rows if every is None else every.unionByName(rows)
    return (
        every.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct("_order", *columns)).alias("r"))
        .select(key, "r.*")
    )


def _list_order(apps: DataFrame) -> DataFrame:
    return apps.withColumns({"_c": -F.col("completed_ms"), "_s": -F.col("started_ms")})


def ranked_app_list(apps: DataFrame, tie: str = "app_id") -> DataFrame:
    """Applications with their place in the list: newest end first, running ones last."""
    ordered = Series(_list_order(apps), [], ["_c", "_s", "usr", tie]).row_number("place")
    return ordered.df.drop("_c", "_s")


def app_list(apps: DataFrame, tie: str = "app_id") -> DataFrame:
    return apps.orderBy(F.desc("completed_ms"), F.desc("started_ms"), F.asc("usr"), F.asc(tie))


def app_page(apps: DataFrame, page: int, size: int = 25, tie: str = "app_id") -> DataFrame:
    """One page (0-based) of the application list."""
    return app_list(apps, tie).offset(page * size).limit(size)


def newest_apps(apps: DataFrame, n: int = 10_000, tie: str = "app_id") -> DataFrame:
    return apps.orderBy(F.desc("started_ms"), F.asc(tie)).limit(n)
