"""Sinks: event log, configuration files, and the date-partitioned finished store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.upkeep import expired_partitions, store_partition


#: Folders of applications inside a period.
BUCKETS = 16


def bucket_of(app: str = "k", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(app), F.lit(buckets)).cast("int")


def write_event_log(
    events: DataFrame, path: str, period: str = "yyyy-MM-dd", mode: str = "append", buckets: int | None = None
) -> None:
    """Append events to the log at ``path``, one directory per period of event time and, with ``buckets``, a folder
    for each hash of the application in it, which a scan for few applications skips.

    Files are range-partitioned on (period, application, position) and sorted, so a large
    application spans files, small ones share them, and order survives.
    """
    folders, placed = ["period"], events.withColumn("period", F.date_format(F.timestamp_millis("ts_ms"), period))
    if buckets:
        folders, placed = [*folders, "bucket"], placed.withColumn("bucket", bucket_of("k", buckets))
    order = [*folders, "k", "file_pos"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(*folders).parquet(path)


def write_config(settings: DataFrame, path: str, by: str = "app", mode: str = "error") -> None:
    """Configuration XML, one file per application, from (app, name, value, final, source)."""
    settings.repartition(by).write.mode(mode).partitionBy(by).format("xml").option("rootTag", "configuration").option(
        "rowTag", "property"
    ).save(path)


#: Files of one folder of :func:`write_files`, and of one task.
FOLDER_FILES, TASK_FILES = 2_000, 5_000


def write_files(rows: DataFrame, path: str, by: str, column: str) -> None:
    """A text file for each value of ``by``, a line for each of its rows with ``column`` (text or bytes), below
    ``path/shard=<n>``; its path has ``<by>=<value>``.

    In a folder that tasks can open they write the files themselves: Hadoop's local file system starts three processes for
    each, to give it, its checksum and its folder their permissions. Elsewhere the writer makes a folder for each file.
    """
    spark = rows.sparkSession
    many = rows.count()
    shard = F.pmod(F.xxhash64(by), F.lit(many // FOLDER_FILES + 1)).alias("shard")
    placed = rows.select(shard, by, F.col(column).cast("binary").alias("content")).repartition(max(64, many // TASK_FILES), by)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        text = placed.withColumn("content", F.col("content").cast("string"))
        text.write.partitionBy("shard", by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    fs.mkdirs(base)
    folder = fs.makeQualified(base).toUri().getPath()
    named = placed.withColumn(by, F.col(by).cast("string")).sortWithinPartitions("shard", by)
    named.mapInArrow(_files_in(folder, by), "files long").agg(F.sum("files")).collect()


def _files_in(folder: str, by: str):
    """Writes rows (shard, ``by``, content), in the order of the first two, as files; a file is there whole or not at all."""

    def write(batches):
        import os
        from urllib.parse import quote
        from uuid import uuid4

        import pyarrow as pa

        at, out, files, own = None, None, 0, uuid4().hex

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, f"{folder}/shard={at[0]}/{by}={name(at[1])}.txt")

        name = lambda value: "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe=" ")
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != at:
                    close()
                    at, files = row[:2], files + 1
                    os.makedirs(f"{folder}/shard={at[0]}", exist_ok=True)
                    out = open(f"{folder}/shard={at[0]}/.{own}", "wb")
                out.write((row[2] or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def name_files(spark: SparkSession, path: str, name: str) -> int:
    """Give the one file that :func:`write_config` wrote in each folder of ``path`` the name ``name``; returns how many."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = fs_path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [
        (f.getPath(), d.getPath()) for d in fs.listStatus(base) if d.isDirectory()
        for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")
    ]
    for file, folder in found:
        fs.rename(file, fs_path(folder, name))
    return len(found)


def write_finished(files: DataFrame, path: str, zone: str = "UTC", mode: str = "append") -> None:
    """Finished history rows under year/month/day of their completion; open ones stay out."""
    placed = store_partition(files, zone)
    placed.repartitionByRange("year", "month", "day", "name").write.mode(mode).partitionBy(
        "year", "month", "day"
    ).parquet(path)


def _folders(fs, path, prefix: str) -> list:
    """(value, path) of the folders ``prefix=value`` below ``path``."""
    named = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(path) if f.isDirectory()]
    return [(name[len(prefix) + 1:], at) for name, at in named if name.startswith(f"{prefix}=")]


def purge_finished(spark: SparkSession, path: str, cutoff: str) -> list[tuple[str, str]]:
    """Drop the folders (year, then month, then day) of the store at ``path`` that lie before ``cutoff`` (a date) whole.

    Only names are read and only folders deleted, the coarsest first: no file that survives is opened or written.
    Returns (level, folder) of what went. Folders are as many as days; names that are no dates stay.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = [
        (y, m, d, at.toString())
        for y, below_y in _folders(fs, base, "year") for m, below_m in _folders(fs, below_y, "month") for d, at in _folders(fs, below_m, "day")
    ]
    days = spark.createDataFrame(found, "year string, month string, day string, folder string")
    level = F.col("level")
    up = F.when(level == "year", 2).when(level == "month", 1).otherwise(0)
    parts = F.split("folder", "/")
    gone = expired_partitions(days, F.lit(cutoff).cast("date")).select(
        "level", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/").alias("folder")
    )
    dropped = sorted({(r["level"], r["folder"]) for r in gone.collect()}, key=lambda r: (len(r[1]), r))
    for _, folder in dropped:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return dropped
