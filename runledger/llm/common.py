"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: str) -> DataFrame:
    """``make`` turns an Arrow batch into the columns of the result, null values kept as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            made = make(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Adds ``name``, a number from 0 without gaps inside each group, in the order of a hash of ``order``.

    A group of any size is spread over ``buckets`` windows: rows are numbered inside their bucket, and the
    sizes of the buckets before it (at most ``buckets`` rows a group) are added. ``df`` is evaluated twice.
    """
    keys = [*group, "_bucket"]
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = (
        hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    inside = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return (
        inside.join(before, keys).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_before", "_rank")
    )
