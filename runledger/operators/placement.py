"""Hosts, ranks and cluster specs of applications, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.config import host_port
from runledger.operators.series import Series

DRIVER_ROLE = "driver"


def cluster_members(tasks: DataFrame, port: str = "port") -> DataFrame:
    """Cluster spec rows (k, role, pos, host_port); the index of a task is its place."""
    return tasks.where(F.col("host").isNotNull()).select(
        "k", "role", F.col("idx").alias("pos"), host_port("host", port).alias("host_port")
    )


def host_processes(tasks: DataFrame, driver_role: str = DRIVER_ROLE) -> DataFrame:
    """Processes per host of an application, its driver left out."""
    return (
        tasks.where(F.col("role") != driver_role)
        .groupBy("k", "host")
        .agg(F.count(F.lit(1)).cast("int").alias("processes"))
    )


def host_list(processes: DataFrame) -> DataFrame:
    """``h1:n1,h2:n2`` per application, by host; one entry per host of the cluster at most."""
    item = F.concat("host", F.lit(":"), F.col("processes").cast("string"))
    return processes.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("hosts"))


SLOT_BLOCK = 10_000


def _slots(hosts: DataFrame, count: str, name: str) -> DataFrame:
    """One row per slot number below ``count``, in blocks so that no row holds all of them."""
    last = F.col(count) - 1
    blocks = hosts.where(F.col(count) > 0).withColumn("_b", F.explode(F.sequence(F.lit(0), last, F.lit(SLOT_BLOCK))))
    return blocks.withColumn(
        name, F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + (SLOT_BLOCK - 1), last)))
    ).drop("_b")


def rank_plan(processes: DataFrame, hot: bool | None = None) -> DataFrame:
    """Every slot of an application with its ranks and the sizes they run in.

    Hosts stand in name order. Rank counts all slots, local rank those of the host, cross rank
    the hosts that have a slot with that local rank.
    """
    n, one = F.col("processes").cast("long"), F.lit(1).cast("long")
    hosts = Series(processes, ["k"], ["host"], hot).running(_upto=n).total(_size=n).df
    slots = Series(_slots(hosts, "processes", "local_rank"), ["k", "local_rank"], ["host"], hot)
    plan = slots.row_number("_c").total(_across=one).df
    number = lambda c, name: c.cast("int").alias(name)
    return plan.select(
        "k", "host", number(F.col("_upto") - F.col("processes") + F.col("local_rank"), "rank"), "local_rank",
        number(F.col("_c") - 1, "cross_rank"), number(F.col("_size"), "size"),
        F.col("processes").alias("local_size"), number(F.col("_across"), "cross_size"),
    )


def local_sequence(tasks: DataFrame, hot: bool | None = None, driver_role: str = DRIVER_ROLE) -> DataFrame:
    """Place of each task among those of its application on the same host, by index."""
    workers = tasks.where(F.col("role") != driver_role)
    placed = Series(workers, ["k", "host"], ["idx", "role"], hot).row_number("_n").df
    return placed.withColumn("local_seq", (F.col("_n") - 1).cast("int")).drop("_n")


def assign_slots(tasks: DataFrame, plan: DataFrame, hot: bool | None = None) -> DataFrame:
    """The n-th task on a host takes the host's n-th slot."""
    placed = local_sequence(tasks, hot).select("k", "role", "idx", "host", F.col("local_seq").alias("local_rank"))
    return placed.join(plan, ["k", "host", "local_rank"])
