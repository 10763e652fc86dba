"""Metric samples, GPU snapshots and heartbeats.

samples(task, id, ts_ms, value): a null value is a failed sample. pings(task, id, ts_ms, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.config import percent_used
from runledger.operators.series import Series
from runledger.operators.skew import dim_join

UNSET = -1.0
ORDER = ["ts_ms", "id"]


def running_maximum(samples: DataFrame) -> DataFrame:
    return samples.groupBy("task").agg(
        F.greatest(F.coalesce(F.max("value"), F.lit(UNSET)), F.lit(UNSET)).alias("max_value")
    )


def running_average(
    samples: DataFrame, hot: bool | None = None, start: DataFrame | None = None
) -> DataFrame:
    """Average after all samples, where each sample n counts from 0, failed ones included.

    A sample v makes the average (avg * n + v) / (n + 1); a failed one leaves it and only n
    advances. With w = the product of n / (n + 1) over later samples, the end value is the sum
    of v / (n + 1) * w, plus the start value times the whole product unless sample 0 was good.
    Products run as sums of logarithms, so both steps are mergeable sums and no list is built.

    ``start``: task, refreshes, avg_value to go on from.
    """
    good = F.col("value").isNotNull()
    placed = Series(samples, ["task"], ORDER, hot).row_number("_n")
    if start is not None:
        before = start.select("task", F.col("refreshes").alias("_n0"), F.col("avg_value").alias("_avg0"))
        placed = placed.map(lambda df: dim_join(df, before, "task", "left", [] if hot is False else None))
        at = F.col("_n") + F.coalesce("_n0", F.lit(0).cast("long"))
    else:
        placed = placed.map(lambda df: df.withColumn("_avg0", F.lit(None).cast("double")))
        at = F.col("_n")
    n1 = at.cast("double")
    shrink = F.when(good & (at > 1), F.log((n1 - 1) / n1)).otherwise(F.lit(0.0))
    logs = placed.map(lambda df: df.withColumn("_at", at)).running(_log=shrink).df
    seen = logs.groupBy("task").agg(
        F.sum(F.when(good, F.col("value") / F.col("_at") * F.exp(-F.col("_log")))).alias("_sum"),
        F.min("_log").alias("_all"),
        F.bool_or((F.col("_at") == 1) & good).alias("_first_good"),
        F.max("_at").alias("refreshes"),
        F.max("_avg0").alias("_avg0"),
    )
    first = F.when(F.col("_first_good"), F.lit(0.0)).otherwise(F.coalesce("_avg0", F.lit(UNSET)))
    return seen.select(
        "task", "refreshes", (F.exp("_all") * (F.coalesce("_sum", F.lit(0.0)) + first)).alias("avg_value")
    )


def gpu_metrics(gpus: DataFrame, key: str) -> DataFrame:
    """Maximum and mean over the GPUs of each snapshot: utilisation, FB and BAR1 memory percent."""
    fb, bar1 = percent_used("fb_used", "fb_free"), percent_used("bar1_used", "bar1_free")
    return gpus.groupBy(key).agg(
        F.max("utilization").alias("max_utilization"), F.avg("utilization").alias("avg_utilization"),
        F.max(fb).alias("max_fb_percent"), F.avg(fb).alias("avg_fb_percent"),
        F.max(bar1).alias("max_bar1_percent"), F.avg(bar1).alias("avg_bar1_percent"),
    )


def latest(rows: DataFrame, value: str = "value") -> DataFrame:
    """The newest row's value per task, replaced as a whole."""
    newest = F.max(F.struct(*ORDER, value))
    return rows.groupBy("task").agg(newest.alias("_r")).select("task", f"_r.ts_ms", f"_r.{value}")


def as_of_metrics(
    finishes: DataFrame, samples: DataFrame, metrics: str = "metrics", hot: bool | None = None
) -> DataFrame:
    """Each finish (task, id, ts_ms) with the newest metrics at or before it; none gives null.

    One ordered pass over both tables; samples come first at equal times.
    """
    both = finishes.select("task", "id", "ts_ms", F.lit(1).alias("_side")).unionByName(
        samples.select("task", "id", "ts_ms", metrics, F.lit(0).alias("_side")), allowMissingColumns=True
    )
    seen = Series(both, ["task"], ["ts_ms", "_side", "id"], hot).last_seen(
        **{f"_{metrics}": F.when(F.col("_side") == 0, F.struct(metrics))}
    )
    return seen.df.where("_side = 1").select("task", "id", "ts_ms", F.col(f"_{metrics}.{metrics}").alias(metrics))


def heartbeat_gaps(pings: DataFrame, interval_ms: int, misses: int = 25, hot: bool | None = None) -> DataFrame:
    """Time since the task's previous call, and whether it was too long."""
    expiry = interval_ms * max(3, misses)
    gaps = Series(pings, ["task"], ORDER, hot).previous(previous_ms=F.col("ts_ms")).df
    gap = F.col("ts_ms") - F.col("previous_ms")
    return gaps.withColumns({"gap_ms": gap, "dead": F.coalesce(gap > expiry, F.lit(False))})


def liveness_sessions(pings: DataFrame, expiry_ms: int, hot: bool | None = None) -> DataFrame:
    """Runs of calls no further apart than the expiry: start, last call, length, and state.

    Monitoring starts at a registration, each call re-arms it, a result ends it, and so does
    death; so nothing carries over from one run to the next. A run whose newest registration
    or result is a registration ends with the task's death, ``expiry_ms`` after its last call.
    """
    opened = Series(pings, ["task"], ORDER, hot).previous(_p=F.col("ts_ms"))
    fresh = F.col("_p").isNull() | (F.col("ts_ms") - F.col("_p") > expiry_ms)
    runs = opened.running(session=F.when(fresh, 1).otherwise(0).cast("long")).df
    mark = F.when(F.col("kind").isin("register", "result"), F.struct(*ORDER))
    return runs.groupBy("task", "session").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.max_by(F.col("kind"), mark) == "register", F.lit(False)).alias("monitored"),
    )


def dead_tasks(sessions: DataFrame, expiry_ms: int, as_of_ms: Column) -> DataFrame:
    """Tasks deemed dead by ``as_of_ms``, with the time of death."""
    return (
        sessions.where("monitored")
        .withColumn("dead_ms", F.col("last_ms") + expiry_ms)
        .where(F.col("dead_ms") < as_of_ms)
        .select("task", "last_ms", "dead_ms")
    )


def failure_runs(samples: DataFrame, limit: int, hot: bool | None = None) -> DataFrame:
    """Failed samples in a row up to each sample, reset by a good one; tripped beyond ``limit``."""
    bad = F.col("value").isNull()
    counted = Series(samples, ["task"], ORDER, hot).running(_bad=bad.cast("long"))
    based = counted.last_seen(_base=F.when(~bad, F.col("_bad"))).df
    run = F.col("_bad") - F.coalesce("_base", F.lit(0).cast("long"))
    return based.withColumns({"run": run, "tripped": run > limit}).drop("_bad", "_base")


def changed_snapshots(polls: DataFrame, columns: list[str], hot: bool | None = None) -> DataFrame:
    """Does each poll of a task differ from the one before it."""
    state = F.struct(*columns)
    seen = Series(polls, ["task"], ORDER, hot).previous(_p=state).df
    return seen.withColumn("changed", ~state.eqNullSafe(F.col("_p"))).drop("_p")


def every_nth(polls: DataFrame, n: int = 20, hot: bool | None = None) -> DataFrame:
    """Polls 1, n+1, 2n+1, ... of each task."""
    placed = Series(polls, ["task"], ORDER, hot).row_number("poll").df
    return placed.where(F.col("poll") % n == 1)


def first_per_interval(polls: DataFrame, interval_ms: int = 15_000) -> DataFrame:
    """At most one poll of a task per interval: the first."""
    return (
        polls.groupBy("task", F.floor(F.col("ts_ms") / interval_ms).alias("interval"))
        .agg(F.min(F.struct(*ORDER)).alias("_r"))
        .select("task", "interval", "_r.ts_ms", "_r.id")
    )


def interval_rollup(samples: DataFrame, interval_ms: int) -> DataFrame:
    """Count, maximum and mean of the good samples per task and interval."""
    start = F.floor(F.col("ts_ms") / interval_ms) * interval_ms
    return samples.groupBy("task", start.alias("start_ms")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value")
    )
