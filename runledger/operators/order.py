"""Task and text orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import _col
from runledger.functions.predicates import attention_rank
from runledger.operators.series import Series


def by_attention(tasks: DataFrame, hot: bool | None = None) -> DataFrame:
    """Place of each task in its application: status needing attention, name, numeric index."""
    ranked = tasks.withColumn("_a", attention_rank("status"))
    return Series(ranked, ["k"], ["_a", "role", "idx"], hot).row_number("place").df.drop("_a")


def by_task_id(tasks: DataFrame, hot: bool | None = None) -> DataFrame:
    """Place of each task in its application: name, then the index as text (10 before 2)."""
    text = tasks.withColumn("_t", F.col("idx").cast("string"))
    return Series(text, ["k"], ["role", "_t"], hot).row_number("place").df.drop("_t")


def first_lines(text: Column | str, n: int = 20) -> Column:
    """The first ``n`` lines of a text, each closed by a newline."""
    t = F.regexp_replace(_col(text), "\r\n|\r", "\n")
    lines = F.slice(F.split(F.regexp_replace(t, "\n\\z", ""), "\n"), 1, n)
    return F.when(t == "", "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
