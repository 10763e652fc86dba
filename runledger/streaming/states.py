"""Streams of running aggregates: task states, gangs, countdowns, flags and why applications ended.

Each is one aggregate in update mode: a batch is combined on the map side, merged into the engine's state, and the rows it
changed come out with it. A busy application sends a row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.predicates import SUCCESS, is_failed, task_status
from runledger.operators.history import TASK_FINISHED, TASK_STARTED
from runledger.operators.tasks import REASONS


def task_states(events: DataFrame) -> DataFrame:
    """State of each task; the first terminal event wins, in whatever order they come."""
    finished = F.col("kind") == TASK_FINISHED
    state = (
        events.where(F.col("kind").isin(TASK_STARTED, TASK_FINISHED))
        .groupBy("k", "role", "idx")
        .agg(
            F.min(F.when(F.col("kind") == TASK_STARTED, F.col("ts_ms"))).alias("running_ms"),
            F.min(F.when(finished, F.struct("ts_ms", "file_pos", "exit_code"))).alias("end"),
        )
    )
    return state.select(
        "k", "role", "idx", "running_ms", F.col("end.ts_ms").alias("ended_ms"), task_status("end.exit_code").alias("status")
    )


def gang_release(registrations: DataFrame, expected: DataFrame) -> DataFrame:
    """k, release_ms: when the last expected task of an application registered, in the batch in which it did.

    ``registrations``: k, task, ts_ms; a task that registers again counts once. ``expected``: k, expected.
    """
    first = registrations.dropDuplicates(["k", "task"])
    state = first.groupBy("k").agg(F.count(F.lit(1)).alias("registered"), F.max("ts_ms").alias("release_ms"))
    return state.join(expected, "k").where("registered = expected").select("k", "release_ms")


def dependency_countdown(finishes: DataFrame, instances: DataFrame, edges: DataFrame) -> DataFrame:
    """k, role, depends_on, left, ready, at_ms: instances that a role still waits for, after each batch with one.

    ``finishes``: k, role, idx, ts_ms, one a task. ``instances``: k, role, instances. ``edges``: role, depends_on, and k where
    applications differ. A pair is ready once, when nothing is left; at_ms is the latest finish so far.
    """
    by = ["k", "depends_on"] if "k" in edges.columns else ["depends_on"]
    counts = finishes.groupBy("k", "role").agg(F.count(F.lit(1)).alias("done"), F.max("ts_ms").alias("at_ms"))
    left = counts.join(instances, ["k", "role"]).select(
        "k", F.col("role").alias("depends_on"), (F.col("instances") - F.col("done")).alias("left"), "at_ms"
    )
    return left.join(edges, by).select("k", "role", "depends_on", "left", (F.col("left") == 0).alias("ready"), "at_ms")


def untracked_failures(events: DataFrame, untracked: Column) -> DataFrame:
    """k, untracked_failed, at_ms: did an untracked task fail, and when first."""
    bad = (F.col("kind") == TASK_FINISHED) & untracked & is_failed()
    first = F.min(F.when(bad, F.col("ts_ms")))
    return events.groupBy("k").agg(first.isNotNull().alias("untracked_failed"), first.alias("at_ms"))


def all_done(events: DataFrame, tracked: DataFrame) -> DataFrame:
    """k, at_ms: when the last tracked task ended. ``events`` holds ends of tracked tasks, one a task; ``tracked``: k, tracked."""
    ends = events.groupBy("k").agg(F.count(F.lit(1)).alias("_done"), F.max("ts_ms").alias("at_ms"))
    return ends.join(tracked, "k").where("_done = tracked").select("k", "at_ms")


# Fixed: kinds of supervision events.
CLIENT_STOP, PREPROCESSED = "CLIENT_STOP", "PREPROCESS_FINISHED"


def event_signals(events: DataFrame, chief_role: str = "chief") -> DataFrame:
    """k, at_ms, reason: what a single event says about the end of its application.

    ``events``: k, ts_ms, kind, role, exit_code, and of the application's settings ``tracked`` and ``stops`` (of the event's
    role), ``strict``, ``single_node`` and ``bad_graph`` (its dependencies hold a cycle; told by its start).
    """
    kind, code = F.col("kind"), F.col("exit_code")
    ended = kind == TASK_FINISHED
    decides = (F.col("role") == chief_role) & (code == SUCCESS)
    ruin = is_failed() & F.col("tracked") & (F.col("strict") | F.col("stops") | (F.col("role") == chief_role))
    said = {
        "client_stop": kind == CLIENT_STOP,
        "training_finished": ended & (decides | ruin),
        "preprocess_failed": (kind == PREPROCESSED) & (code != SUCCESS),
        "single_node_finished": (kind == PREPROCESSED) & F.col("single_node"),
        "untracked_failed": ended & ~F.col("tracked") & is_failed(),
        "bad_graph": (kind == "APPLICATION_INITED") & F.col("bad_graph"),
    }
    flags = F.array_compact(F.array(*(F.when(flag, name) for name, flag in said.items())))
    return events.select("k", F.col("ts_ms").alias("at_ms"), F.explode(flags).alias("reason"))


def first_reason(signals: DataFrame) -> DataFrame:
    """k, reason, at_ms: of the signals (k, at_ms, reason) of an application the earliest, at one time the first in the fixed order."""
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    first = signals.groupBy("k").agg(F.min(F.struct("at_ms", rank.alias("rank"), "reason")).alias("r"))
    return first.select("k", "r.reason", "r.at_ms")
