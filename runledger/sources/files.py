"""Directory and configuration-file scans of the history store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from runledger.functions.names import APP_ID, full_match
from runledger.schemas import PROPERTY
from runledger.session import in_force, scratch_dir

#: Files that one scan takes at once: the driver keeps name and length of each, and a task opens some hundred.
LISTED = 50_000
SMALL_FILES = {"spark.sql.files.openCostInBytes": "65536", "spark.sql.sources.parallelPartitionDiscovery.threshold": "8"}


def _scans(spark: SparkSession, path: str, most: int) -> list[list[str]]:
    """What lies directly below ``path`` in lots of about ``most`` files, as far as the names one level down tell."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base) or fs.getFileStatus(base).isFile():
        return []
    lots, room, seen, inside = [], 0, 0, 0
    for f in fs.listStatus(base):
        name, n = f.getPath().getName(), 1
        if name.startswith(".") or name.startswith("_") and "=" not in name:
            continue
        if f.isDirectory():  # beyond a hundred folders, as many files as in those
            if seen < 100:
                seen, inside = seen + 1, inside + len(fs.listStatus(f.getPath()))
            n = max(1, inside // seen)
        if not lots or room < n:
            lots.append([])
            room = max(n, most)
        lots[-1].append(f.getPath().toString())
        room -= n
    return lots


def folder_by_folder(
    spark: SparkSession, path: str, read: Callable[[DataFrameReader, list[str]], DataFrame], label: str, most: int = LISTED
) -> DataFrame:
    """``read(reader, paths)`` of all files below ``path``, at any depth.

    Up to ``most`` files, as far as the names tell, are one scan. More are read lot after lot, each written out before
    the next is listed, so that the driver never holds the names of all.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", "true")
    lots = _scans(spark, path, most)
    if len(lots) < 2:
        return read(reader(), [path])
    out = scratch_dir(spark, label)
    listers = max(32, 4 * spark.sparkContext.defaultParallelism)
    with in_force(spark, SMALL_FILES | {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(listers)}):
        for paths in lots:
            found = read(reader().option("__globPaths__", "false"), paths)
            found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def listed_files(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Path, modification time and length of every file below ``root``; no content is read."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        files = files.schema("path string, modificationTime timestamp, length bigint, content binary")
    return files.load(root).select("path", "modificationTime", "length")


def _matching_dirs(path: Column, pattern: str) -> Column:
    parts = F.split(path, "/")
    upto = F.sequence(F.lit(1), F.size(parts) - 1)
    hits = F.filter(upto, lambda i: full_match(F.element_at(parts, i), pattern))
    return F.transform(hits, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def job_directories(files: DataFrame, pattern: str = APP_ID) -> DataFrame:
    """Directories at any depth whose last component matches, with their newest change."""
    found = files.select(
        F.explode(_matching_dirs(F.col("path"), pattern)).alias("dir"), "modificationTime"
    )
    return found.groupBy("dir").agg(F.max("modificationTime").alias("modified"))


def read_job_directories(spark: SparkSession, root: str, pattern: str = APP_ID) -> DataFrame:
    return job_directories(listed_files(spark, root), pattern)


def stream_job_files(spark: SparkSession, root: str, pattern: str = APP_ID) -> DataFrame:
    """New or changed files of matching directories, as a stream; one row per (dir, file)."""
    return listed_files(spark, root, stream=True).select(
        F.explode(_matching_dirs(F.col("path"), pattern)).alias("dir"), "path", "modificationTime"
    )


def _uri(path: Column) -> Column:
    """Local paths in one spelling: both scans name the same file, one with more slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _rank(path: str) -> Column:
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(name.endswith("-final.xml"), 0).when(name == "config.xml", 1)


def read_config(spark: SparkSession, root: str, part_files: bool = False) -> DataFrame:
    """(dir, name, value, final, source) of each application's configuration.

    Of the files of one directory the final one is read, else ``config.xml``; with
    ``part_files`` all files of a directory written by Spark. Rows without name or value are
    dropped; of several sources the first counts.
    """
    rows = (
        spark.read.format("xml").schema(PROPERTY).option("rowTag", "property")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*" if part_files else "*.xml")
        .load(root)
        .select("name", "value", "final", "source", F.col("_metadata.file_path").alias("path"))
        .where(F.col("name").isNotNull() & F.col("value").isNotNull())
        .withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    )
    if not part_files:
        ranked = rows.withColumn("_r", _rank("path")).where(F.col("_r").isNotNull())
        # Both scans name files as the metadata column does, which escapes them in one way.
        best = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"))
        best = best.select("path", _rank("path").alias("_r")).where(F.col("_r").isNotNull())
        best = best.groupBy(_uri(F.regexp_replace("path", r"/[^/]*$", "")).alias("dir")).agg(F.min("_r").alias("_r"))
        rows = ranked.withColumn("dir", _uri(F.col("dir"))).join(best, ["dir", "_r"], "left_semi")
    return rows.select(
        "dir", "name", "value",
        F.coalesce(F.lower(F.trim("final")) == "true", F.lit(False)).alias("final"),
        F.get("source", F.lit(0)).alias("source"),
    )
