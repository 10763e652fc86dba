"""Set differences of task snapshots and role lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_tasks(expected: DataFrame, registered: DataFrame) -> DataFrame:
    """Expected (app, task) pairs that have not registered."""
    return expected.subtract(registered)


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one snapshot without a counterpart in the other, tagged by side.

    One aggregate over both: rows cancel out by count, as with two multiset differences.
    """
    both = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1)))
    return _net(both, before.columns)


def revised(rows: DataFrame, keys: list[str], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """The difference of two snapshots that are both made from ``rows``, which are read once.

    ``before`` and ``after`` name the columns of the two. A row that is the same in both has no part in the result
    and is left out before anything is dealt out.
    """
    state = lambda columns: F.struct(*keys, *(c.alias(n) for n, c in columns.items()))
    pairs = rows.select(state(before).alias("_b"), state(after).alias("_a")).where(~F.col("_a").eqNullSafe(F.col("_b")))
    signed = F.array(F.struct(F.col("_b").alias("r"), F.lit(1).alias("_n")), F.struct(F.col("_a").alias("r"), F.lit(-1).alias("_n")))
    return _net(pairs.select(F.inline(signed)).select("r.*", "_n"), [*keys, *before])


def _net(both: DataFrame, columns: list[str]) -> DataFrame:
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    copies = F.sequence(F.lit(1).cast("long"), F.abs("_n"))
    side = F.when(F.col("_n") > 0, "before").otherwise("after").alias("side")
    return net.select(*columns, side, F.explode(copies).alias("_c")).drop("_c")


def role_union(*lists: Column) -> Column:
    """Role lists as one, without repeats, in first-seen order."""
    out = lists[0]
    for other in lists[1:]:
        out = F.array_union(out, other)
    return out


def add_role(roles: Column, role: Column | str) -> Column:
    """A comma list of roles with one more at its end."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.when(F.coalesce(roles, F.lit("")) == "", role).otherwise(F.concat_ws(",", roles, role))


def is_same(before: DataFrame, after: DataFrame) -> bool:
    """True if two snapshots hold the same rows."""
    return snapshot_difference(before, after).isEmpty()
