"""Task-state analytics over tasks(k, role, idx, host, start_ms, end_ms, exit_code).

Counts and decisions are single mergeable aggregates per application, so a hot application is
combined on the map side; per-row orders go through :class:`Series`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.predicates import (
    KILLED_BY_MASTER,
    SUCCESS,
    attention_rank,
    is_completed,
    is_failed,
    task_status,
)
from runledger.operators.series import Series
from runledger.session import written



def _flag(value: Column | bool) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _by(rules: DataFrame, *columns: str) -> list[str]:
    """Join columns of rules from configuration: with the application, where each has its own."""
    return ["k", *columns] if "k" in rules.columns else list(columns)


def unregistered_tasks(tasks: DataFrame) -> DataFrame:
    """Launched tasks whose host is not known yet."""
    return tasks.where(F.col("start_ms").isNotNull() & F.col("host").isNull())


def _counts(tracked: Column) -> list[Column]:
    done = is_completed()
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(tracked).alias("tracked"), F.count_if(done).alias("completed"),
        F.count_if(done & tracked).alias("completed_tracked"), F.count_if(is_failed()).alias("failed"),
    ]


def counters(tasks: DataFrame, tracked: Column) -> DataFrame:
    return tasks.groupBy("k").agg(*_counts(tracked))


def progress(counted: DataFrame) -> DataFrame:
    return counted.withColumn(
        "progress", F.coalesce(F.try_divide("completed_tracked", "tracked"), F.lit(0.0))
    )


def final_status(tasks: DataFrame, tracked: Column, strict: Column | bool = False, counted: bool = False) -> DataFrame:
    """Status and message of each application from its tracked tasks. ``strict`` is the same on all its rows.

    ``counted``: with the columns of :func:`counters`, from the same aggregate.
    """
    open_ = tracked & ~is_completed()
    bad = tracked & (F.col("exit_code") != SUCCESS)
    counts = _counts(tracked) if counted else []
    seen = tasks.groupBy("k").agg(
        F.count_if(tracked).alias("_tracked"),
        F.min(F.when(open_, F.struct("role", "idx"))).alias("_open"),
        F.count_if(bad).alias("failures"),
        F.bool_or(_flag(strict)).alias("_strict"),
        *counts,
    )
    columns = [c for c in ("total", "tracked", "completed", "completed_tracked", "failed") if counted]
    failures = F.col("failures")
    unfinished = F.col("_open").isNotNull()
    broken = (failures > 0) & (F.col("_strict") | (failures >= F.col("_tracked")))
    count = F.concat(F.lit("failedCnt="), failures.cast("string"))
    return seen.select(
        "k", *columns,
        F.when(unfinished | broken, "FAILED").otherwise("SUCCEEDED").alias("status"),
        # Fixed: the texts of these messages are output values.
        F.when(
            unfinished,
            F.concat(
                F.lit("Job "), F.col("_open.role"), F.lit(":"), F.col("_open.idx").cast("string"),
                F.lit(" hasn't finished yet."),
            ),
        )
        .when(broken, F.concat(F.lit("At least one job task exited with non-zero status, "), count))
        .when(failures > 0, F.concat(F.lit("Training completed with some worker jobs failure, "), count))
        .alias("message"),
    )


def fail_fast(
    tasks: DataFrame, stop_roles: Column | list[str] = (), strict: Column | bool = False, chief_role: str = "chief",
    worker_role: str = "worker",
) -> DataFrame:
    """Applications ended by one task: the first failed finish of a chief, of a stop-on-failure
    role (a list, or a condition on the task), or (strict) of any role."""
    role, code = F.col("role"), F.col("exit_code")
    fatal = code.isNotNull() & ~code.isin(SUCCESS, KILLED_BY_MASTER)
    stops = stop_roles if isinstance(stop_roles, Column) else role.isin(list(stop_roles))
    named = fatal & (_flag(strict) | (role == chief_role) | stops)
    stand_in = fatal & (role == worker_role) & (F.col("idx") == 0)
    first = lambda when: F.min(F.when(when, F.struct("end_ms", "role", "idx", "exit_code", "host")))
    # Only rows that can decide are combined; applications without any have no cause.
    seen = tasks.where((role == chief_role) | named | stand_in).groupBy("k").agg(
        F.bool_or(role == chief_role).alias("_chief"), first(named).alias("_a"), first(stand_in).alias("_b")
    )
    cause = F.when(F.col("_chief"), F.col("_a")).otherwise(F.least("_a", "_b"))
    text = lambda f: F.col(f"_t.{f}").cast("string")
    return (
        seen.select("k", cause.alias("_t"))
        .where(F.col("_t").isNotNull())
        .select(
            "k", F.col("_t.role").alias("role"), F.col("_t.idx").alias("idx"),
            F.col("_t.end_ms").alias("at_ms"), F.lit("FAILED").alias("status"),
            # Fixed: the text is an output value.
            F.concat(
                F.lit("Job "), text("role"), F.lit(":"), text("idx"), F.lit(" exited with "),
                text("exit_code"), F.lit(" on host:"), text("host"), F.lit(". Exit status: "),
                text("exit_code"),
            ).alias("diagnostic"),
        )
    )


def chief_tasks(
    tasks: DataFrame, chief_role: str = "chief", worker_role: str = "worker"
) -> DataFrame:
    """The chief tasks; in applications without that role, worker 0."""
    chiefs = tasks.where(F.col("role") == chief_role)
    with_chief = chiefs.select("k").distinct()
    stand_ins = tasks.where((F.col("role") == worker_role) & (F.col("idx") == 0))
    return chiefs.unionByName(stand_ins.join(with_chief, "k", "left_anti"))


def released_snapshot(tasks: DataFrame, launched: Column) -> DataFrame:
    """Task infos of applications all of whose slots are launched.

    Rows of a task are merged once; applications with a slot that is not launched (their numbers only) are left out.
    """
    columns = [c for c in tasks.columns if c not in ("k", "role", "idx")]
    one = tasks.groupBy("k", "role", "idx").agg(F.bool_and(launched).alias("_all"), F.min(F.struct(*columns)).alias("r"))
    merged = written(one.select("k", "role", "idx", "_all", "r.*"), "slots")
    waiting = merged.where("NOT _all").select("k").distinct()
    return merged.join(waiting, "k", "left_anti").drop("_all")


def role_summary(tasks: DataFrame) -> DataFrame:
    """Per (app, role): instances, how many still run, latest end (0 if none ended)."""
    return tasks.groupBy("k", "role").agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if(~is_completed()).alias("running"),
        F.coalesce(F.max(F.when(is_completed(), F.col("end_ms"))), F.lit(0).cast("long")).alias("latest_end"),
    )


def group_completion(roles: DataFrame, members: DataFrame) -> DataFrame:
    """Per (app, group) of a role summary: are all members done, and when did the last end.

    ``members``: grp, role, from configuration, and k where applications differ. Roles an application lacks do
    not count.
    """
    return (
        roles.join(members, _by(members, "role"))
        .groupBy("k", "grp")
        .agg(
            (F.max("running") == 0).alias("done"),
            F.max("latest_end").alias("latest_end"),
            F.sum("instances").alias("instances"),
        )
    )


def awaited_groups(roles: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """Running roles of a role summary that wait for a group, with the state of that group.

    ``rules``: role, grp, timeout_s, ignored, and k where applications differ (then in ``members`` too). One
    group per role: the last by name.
    """
    # Member and waiting roles meet in one aggregate per (app, group); the list it builds is as
    # long as the rules of a group.
    one = rules.groupBy(*_by(rules, "role")).agg(F.max_by(F.struct("grp", "timeout_s", "ignored"), "grp").alias("r"))
    known = members.select(*_by(members, "grp")).distinct()
    waits = one.select(*_by(rules, "role"), "r.*").join(known, known.columns, "left_semi").withColumn("_member", F.lit(False))
    links = members.withColumn("_member", F.lit(True)).unionByName(waits, allowMissingColumns=True)
    member, waiting = F.col("_member"), ~F.col("_member") & (F.col("running") > 0)
    return (
        roles.join(links, _by(members, "role"))
        .groupBy("k", "grp")
        .agg(
            (F.coalesce(F.max(F.when(member, F.col("running"))), F.lit(0)) == 0).alias("done"),
            F.coalesce(F.max(F.when(member, F.col("latest_end"))), F.lit(0).cast("long")).alias("latest_end"),
            F.collect_list(F.when(waiting, F.struct("role", "timeout_s", "ignored"))).alias("_w"),
        )
        .select("k", "grp", "done", "latest_end", F.inline("_w"))
    )


def group_timeouts(
    tasks: DataFrame, rules: DataFrame, members: DataFrame, as_of_ms: int | Column,
    launched: Column | None = None,
) -> DataFrame:
    """Roles still running too long after the group they depend on ended, and what follows:
    FAILED, or UNTRACKED where the rule says to ignore it. Applications with a slot that is
    not launched are not judged."""
    launched = F.lit(True) if launched is None else launched
    whole = tasks.groupBy("k").agg(F.bool_and(launched).alias("_all")).where("_all").select("k")
    now = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    return overdue(awaited_groups(role_summary(tasks), rules, members).join(whole, "k"), now)


def overdue(awaited: DataFrame, now: Column) -> DataFrame:
    """Awaited groups that ended more than the rule's timeout ago, with the outcome."""
    late = now - F.col("latest_end") > F.col("timeout_s").cast("long") * 1000
    return awaited.where(F.col("done") & (F.col("latest_end") != 0) & late).withColumn(
        "outcome", F.when(F.col("ignored"), "UNTRACKED").otherwise("FAILED")
    )


def overdue_at(roles: DataFrame, tasks: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """k, role, grp, outcome, at_ms: rules that came true at any time: their group was done, and the limit later the role still ran.

    ``roles``: k, role, instances. Rules and members as in :func:`awaited_groups`; without members a rule has no group.
    """
    ends = tasks.groupBy("k", "role").agg(F.count_if(~is_completed()).alias("_open"), F.max(F.when(is_completed(), F.col("end_ms"))).alias("_last"))
    state = roles.select("k", "role").join(ends, ["k", "role"])
    groups = state.join(members, _by(members, "role")).groupBy("k", "grp").agg(F.sum("_open").alias("_left"), F.max("_last").alias("_end"))
    one = rules.groupBy(*_by(rules, "role")).agg(F.max_by(F.struct("grp", "timeout_s", "ignored"), "grp").alias("r")).select(*_by(rules, "role"), "r.*")
    due = F.col("_end") + F.col("timeout_s").cast("long") * 1000
    met = state.join(one, _by(one, "role")).join(groups.where("_left = 0"), ["k", "grp"])
    return met.where((F.col("_open") > 0) | (F.col("_last") > due)).select(
        "k", "role", "grp", F.when(F.col("ignored"), "UNTRACKED").otherwise("FAILED").alias("outcome"), due.alias("at_ms")
    )


def all_ended(tasks: DataFrame) -> DataFrame:
    """k, at_ms: when the last task of each application ended; none while one runs."""
    seen = tasks.groupBy("k").agg(F.bool_and(is_completed()).alias("_all"), F.max("end_ms").alias("at_ms"))
    return seen.where("_all").drop("_all")


def app_timeouts(apps: DataFrame, limit_ms: int, as_of_ms: Column) -> DataFrame:
    """Applications past their time limit (0 is none)."""
    elapsed = as_of_ms - F.col("started_ms")
    return apps.withColumn("elapsed_ms", elapsed).where((F.col("elapsed_ms") > limit_ms) & F.lit(limit_ms > 0))


def match_arrivals(arrivals: DataFrame, slots: DataFrame, hot: bool | None = None) -> DataFrame:
    """The i-th arrival with a priority takes the i-th free slot of the role owning it.

    ``arrivals``: k, priority, ts_ms, id. ``slots``: k, priority, role, idx.
    """
    came = Series(arrivals, ["k", "priority"], ["ts_ms", "id"], hot).row_number("_n").df
    free = Series(slots, ["k", "priority"], ["idx"], hot).row_number("_n").df
    return came.join(free, ["k", "priority", "_n"], "left").drop("_n")


def failed_unregistered(tasks: DataFrame, registered: DataFrame) -> DataFrame:
    """Failed tasks that never registered."""
    return tasks.where(is_failed()).join(registered, ["k", "role", "idx"], "left_anti")


def status_runs(tasks: DataFrame, hot: bool | None = None) -> DataFrame:
    """Tasks per (app, status, role) as runs of indexes that follow on one another, first to last."""
    placed = Series(
        tasks.select("k", task_status("exit_code").alias("status"), "role", "idx"), ["k", "status", "role"], ["idx"], hot
    ).row_number("_n").df
    return placed.groupBy("k", "status", "role", (F.col("idx") - F.col("_n")).alias("_run")).agg(
        F.min("idx").alias("first"), F.max("idx").alias("last")
    ).drop("_run").withColumn("attention", attention_rank("status"))


def status_text(runs: DataFrame) -> DataFrame:
    """``ps [1, 2] worker [0]`` per (app, status), for showing a few applications."""
    each = F.array_join(F.sequence("first", "last").cast("array<string>"), ", ")
    roles = runs.groupBy("k", "status", "role").agg(F.array_sort(F.collect_list(F.struct("first", each.alias("t")))).alias("_i"))
    text = F.concat("role", F.lit(" ["), F.array_join(F.col("_i.t"), ", "), F.lit("]"))
    lines = roles.groupBy("k", "status").agg(F.array_sort(F.collect_list(F.struct("role", text.alias("t")))).alias("_r"))
    return lines.select("k", "status", F.array_join(F.col("_r.t"), " ").alias("text"))


def gang_state(tasks: DataFrame, registered: Column, first_come: bool = False) -> DataFrame:
    """Registered and expected tasks per application; a gang may start when they are equal."""
    seen = tasks.groupBy("k").agg(
        F.count_if(registered).alias("registered"), F.count(F.lit(1)).alias("expected")
    )
    ready = F.lit(True) if first_come else F.col("registered") == F.col("expected")
    return seen.withColumn("ready", ready)


def gang_release(tasks: DataFrame, registered_ms: Column) -> DataFrame:
    """When the last task of each application registered; none while one is missing."""
    seen = tasks.groupBy("k").agg(
        F.bool_and(registered_ms.isNotNull()).alias("_all"), F.max(registered_ms).alias("release_ms")
    )
    return seen.where("_all").drop("_all")


def dependency_countdown(tasks: DataFrame, edges: DataFrame, hot: bool | None = None) -> DataFrame:
    """Instances left per (role, dependency) after each finish of the dependency. ``edges``: role,
    depends_on, and k where applications differ.

    Counting from the far end, tasks still running first, the place of a finish is one more
    than what is left after it, so one ordered pass gives the countdown without totals.
    """
    open_first = tasks.withColumns(
        {
            "_o": F.when(is_completed(), -F.col("end_ms")).otherwise(F.lit(-(2**62))),
            "_i": -F.col("idx"),
        }
    )
    placed = Series(open_first, ["k", "role"], ["_o", "_i"], hot).row_number("_n").df
    finishes = placed.where(is_completed()).select(
        "k", F.col("role").alias("depends_on"), F.col("idx").alias("finished_idx"),
        F.col("end_ms").alias("at_ms"), (F.col("_n") - 1).alias("left"),
    )
    return finishes.join(edges, _by(edges, "depends_on")).withColumn("ready", F.col("left") == 0)


def ready_roles(tasks: DataFrame, edges: DataFrame, as_of_ms: Column) -> DataFrame:
    """Roles with no unfinished dependency instance at a point in time."""
    done = is_completed() & (F.col("end_ms") <= as_of_ms)
    state = tasks.groupBy("k", "role").agg(F.count_if(~done).alias("_left"))
    blocked = (
        state.where("_left > 0").select("k", F.col("role").alias("depends_on")).join(edges, _by(edges, "depends_on"))
    ).select("k", "role")
    return state.select("k", "role").join(blocked, ["k", "role"], "left_anti")


def registration_timeouts(tasks: DataFrame, limit_ms: int, as_of_ms: Column) -> DataFrame:
    """Launched tasks without a host for longer than the limit (off when not positive)."""
    late = (as_of_ms - F.col("start_ms") > limit_ms) & F.lit(limit_ms > 0)
    return unregistered_tasks(tasks).where(late)


def allocation_timeouts(
    tasks: DataFrame, registered: Column, limit_ms: int, as_of_ms: Column, gang: bool = True
) -> DataFrame:
    """Gang applications that still lack tasks longer than the limit after their first launch."""
    seen = tasks.groupBy("k").agg(
        F.min("start_ms").alias("since_ms"), F.count_if(registered).alias("registered"),
        F.count(F.lit(1)).alias("expected"), F.max(as_of_ms).alias("_now"),
    )
    late = (F.col("expected") > F.col("registered")) & (F.col("_now") - F.col("since_ms") > limit_ms)
    return seen.where(late & F.lit(gang and limit_ms > 0)).drop("_now")


def first_terminal_status(events: DataFrame) -> DataFrame:
    """State of every task seen in the log: the first terminal status wins."""
    finished = F.col("kind") == "TASK_FINISHED"
    at = F.when(finished, F.col("file_pos"))
    return (
        events.where(F.col("kind").isin("TASK_STARTED", "TASK_FINISHED"))
        .groupBy("k", "role", "idx")
        .agg(
            F.min_by(F.when(finished, F.col("exit_code")), at).alias("exit_code"),
            F.min(F.when(F.col("kind") == "TASK_STARTED", F.col("ts_ms"))).alias("running_ms"),
            F.min(F.when(finished, F.col("ts_ms"))).alias("ended_ms"),
        )
        .withColumn("status", task_status("exit_code"))
    )


# Why supervision of an application ended; the first true one of these flags is reported.
REASONS = [
    "timeout", "client_stop", "training_finished", "preprocess_failed", "single_node_finished",
    "untracked_failed", "bad_graph", "unhealthy", "registration_timeout", "startup_failed", "all_tracked_done",
]


def termination_reason(flags: dict[str, Column]) -> Column:
    """First true flag in the fixed order; null while supervision goes on."""
    chain = None
    for reason in REASONS:
        if reason in flags:
            hit = F.coalesce(flags[reason], F.lit(False))
            chain = F.when(hit, reason) if chain is None else chain.when(hit, reason)
    return chain


def untracked_failures(tasks: DataFrame, untracked: Column) -> DataFrame:
    """Per application: did an untracked task fail."""
    return tasks.groupBy("k").agg(F.bool_or(untracked & is_failed()).alias("untracked_failed"))
