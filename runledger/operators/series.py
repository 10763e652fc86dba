"""Ordered series: per-key running values that stay parallel inside a hot key.

While no key is hot, each method is one plain window over ``keys``. Otherwise, and always for a series
without keys, the table is
range-partitioned on (keys, order) and written once with its chunk number, windows run per
(chunk, key), and what a key carries into a later chunk is added from a summary. A chunk border
cuts at most one key, so the carried rows number fewer than the chunks and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.skew import HOT_ROWS, has_hot_key
from runledger.session import written

CHUNK = "_chunk"


class Series:
    """Rows of ``df`` in ascending ``order`` (column names) within ``keys``.

    ``hot`` says whether some key needs splitting; ``None`` measures it. ``chunks`` fixes the
    number of pieces of a split table.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        hot: bool | None = None,
        chunks: int | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        self.split = has_hot_key(df, self.keys) if hot is None else hot
        if self.split:
            if chunks is None:
                least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                chunks = max(least, df.count() // HOT_ROWS + 1)
            df = written(
                df.repartitionByRange(chunks, *self.keys, *self.order).withColumn(
                    CHUNK, F.spark_partition_id()
                ),
                "series",
            )
            self.groups = [CHUNK, *self.keys]
        else:
            self.groups = self.keys
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK)

    def _window(self):
        return Window.partitionBy(*self.groups).orderBy(*self.order)

    def _carry(self, summary: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """Per (chunk, key) that a border cut: ``carried`` over the key's earlier chunks."""
        per_chunk = self._df.groupBy(*self.groups).agg(*(c.alias(n) for n, c in summary.items()))
        w = Window.partitionBy(*self.keys).orderBy(CHUNK)
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        return (
            per_chunk.select(
                *self.groups,
                F.count(F.lit(1)).over(past).alias("_past"),
                *(c.over(past).alias(f"_in_{n}") for n, c in carried.items()),
            )
            .where("_past > 0")
            .drop("_past")
        )

    def _with_carry(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        carry = carry.select(
            *(F.col(c).alias(f"_k{i}") for i, c in enumerate(self.groups)),
            *(c for c in carry.columns if c.startswith("_in_")),
        )
        match = F.lit(True)
        for i, c in enumerate(self.groups):
            match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return local.join(F.broadcast(carry), match, "left").drop(
            *(f"_k{i}" for i in range(len(self.groups)))
        )

    def _drop_in(self, df: DataFrame) -> DataFrame:
        return df.drop(*(c for c in df.columns if c.startswith("_in_")))

    def map(self, change) -> Series:
        """Change the rows by a function that keeps keys, order and number of rows."""
        self._df = change(self._df)
        return self

    def running(self, **sums: Column) -> Series:
        """Add the sum of each column from the key's first row up to this one."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        values = {f"_v_{n}": c for n, c in sums.items()}
        base = self._df.withColumns(values)
        if not self.split:
            self._df = base.withColumns({n: F.sum(f"_v_{n}").over(w) for n in sums}).drop(*values)
            return self
        self._df = base
        carry = self._carry(
            {n: F.sum(f"_v_{n}") for n in sums}, {n: F.sum(n) for n in sums}
        )
        local = base.withColumns({n: F.sum(f"_v_{n}").over(w) for n in sums})
        out = self._with_carry(local, carry).withColumns(
            {
                n: F.when(F.col(f"_in_{n}").isNull(), F.col(n)).otherwise(
                    F.col(f"_in_{n}") + F.coalesce(F.col(n), F.lit(0))
                )
                for n in sums
            }
        )
        self._df = self._drop_in(out).drop(*values)
        return self

    def row_number(self, name: str = "rn") -> Series:
        """Add the 1-based position within the key."""
        if not self.split:
            self._df = self._df.withColumn(name, F.row_number().over(self._window()).cast("long"))
            return self
        return self.running(**{name: F.lit(1).cast("long")})

    def total(self, **sums: Column) -> Series:
        """Add the sum of each column over the whole key."""
        values = {f"_v_{n}": c for n, c in sums.items()}
        base = self._df.withColumns(values)
        over_key = Window.partitionBy(*self.keys)
        if not self.split:
            self._df = base.withColumns({n: F.sum(f"_v_{n}").over(over_key) for n in sums}).drop(*values)
            return self
        per_chunk = base.groupBy(*self.groups).agg(*(F.sum(f"_v_{n}").alias(n) for n in sums))
        per_key = per_chunk.withColumns({n: F.sum(n).over(over_key) for n in sums})
        self._df = base.drop(*values).join(per_key, self.groups)
        return self

    def previous(self, **columns: Column) -> Series:
        """Add the value each column had on the key's previous row, null on its first row."""
        w = self._window()
        row = F.struct(*(c.alias(n) for n, c in columns.items()))
        if not self.split:
            self._df = self._df.withColumns({n: F.lag(c, 1).over(w) for n, c in columns.items()})
            return self
        carry = self._carry(
            {"_row": F.max_by(row, F.struct(*self.order))}, {"row": F.last("_row")}
        )
        local = self._df.withColumn("_prev", F.lag(row, 1).over(w)).withColumn(
            "_first", F.row_number().over(w) == 1
        )
        out = self._with_carry(local, carry).withColumn(
            "_prev", F.when(F.col("_first"), F.col("_in_row")).otherwise(F.col("_prev"))
        )
        out = out.withColumns({n: F.col(f"_prev.{n}") for n in columns})
        self._df = self._drop_in(out).drop("_prev", "_first")
        return self

    def last_seen(self, **columns: Column) -> Series:
        """Add the newest non-null value of each column, this row included."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.split:
            self._df = self._df.withColumns(
                {n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()}
            )
            return self
        at = F.struct(*self.order)
        carry = self._carry(
            {n: F.max_by(c, F.when(c.isNotNull(), at)) for n, c in columns.items()},
            {n: F.last(n, ignorenulls=True) for n in columns},
        )
        local = self._df.withColumns(
            {n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()}
        )
        out = self._with_carry(local, carry).withColumns(
            {n: F.coalesce(F.col(n), F.col(f"_in_{n}")) for n in columns}
        )
        self._df = self._drop_in(out)
        return self
