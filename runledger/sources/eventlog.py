"""The event-log source: the stored log, one directory per period, written by ``sinks.store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from runledger.sinks.store import bucket_of


def read_event_log(
    spark: SparkSession, path: str, schema: str | StructType, chosen: DataFrame | None = None, buckets: int | None = None
) -> DataFrame:
    """Events of the log at ``path`` with their stored ``file_pos``, the order within an application.

    ``chosen`` (k, or k and attempt) narrows the scan to these applications or attempts. In a log written with ``buckets``
    only folders of their buckets are opened: the plan knows them before it lists files. A missing or empty folder gives no
    rows; a damaged file gives what can be read before the damage, all others are read (:func:`damaged_files` names them).
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        log = (
            spark.read.schema(StructType([*fields, StructField("bucket", IntegerType())]) if buckets else fields)
            .option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(path)
        )
    except Exception as e:  # the analysis error for a missing path has no class of its own
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if chosen is not None and buckets:
        asked = [r[0] for r in chosen.select(bucket_of("k", buckets)).distinct().collect()]  # at most ``buckets``
        log = log.where(F.col("bucket").isin(asked))
    log = log.select(*fields.names)
    return log if chosen is None else log.join(chosen.distinct(), chosen.columns, "left_semi")


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the log's files that do not end as a Parquet file does, found from their last four bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.where(F.expr("length < 12 OR substring(content, -4, 4) <> X'50415231'")).select("path", "length")


def app_of_path(path: str = "path"):
    """Application id held in the directory of an event file."""
    return F.regexp_extract(path, r"(application_\d+_\d+)[^/]*(?:/[^/]*)?$", 1)
