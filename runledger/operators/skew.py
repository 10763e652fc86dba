"""Finding hot keys and joining past them.

``freqItems`` misses no value above its support and keeps at most 1/support candidates. A value counts
as hot above ``HOT_ROWS`` rows, about what one task should hold, so there are fewer of them than the table
has rows divided by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000


def _candidates(df: DataFrame, column: str, rows: int) -> tuple[list, float]:
    total = df.count()
    if total <= rows:
        return [], 0.0
    found = df.select(column).stat.freqItems([column], rows / total).first()[0]
    return [v for v in found if v is not None], float(rows)


def hot_values(df: DataFrame, column: str, rows: int = HOT_ROWS) -> list:
    """Values of ``column`` held by more than ``rows`` rows."""
    values, limit = _candidates(df, column, rows)
    if not values:
        return []
    counted = (
        df.where(F.col(column).isin(values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    return [r[0] for r in counted.where(F.col("n") > limit).collect()]


def has_hot_key(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> bool:
    """True if one value of ``keys`` holds too many rows for one task. No keys: always."""
    if not keys:
        return True
    keyed = df.select(F.xxhash64(*keys).alias("_key"))
    return bool(hot_values(keyed, "_key", rows))


def dim_join(
    big: DataFrame, dim: DataFrame, on: str, how: str = "inner", hot: list | None = None
) -> DataFrame:
    """``big`` joined to ``dim`` (one row per ``on``), hot keys apart.

    Rows of hot keys meet a broadcast of the few dimension rows that have these keys (one each) and never
    shuffle; all others take the join Spark picks.
    """
    if hot is None:
        hot = hot_values(big, on)
    if not hot:
        return big.join(dim, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    hot_dim = F.broadcast(dim.where(F.col(on).isin(hot)))
    return (
        big.where(~is_hot).join(dim, on, how).unionByName(big.where(is_hot).join(hot_dim, on, how))
    )
