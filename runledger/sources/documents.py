"""Documents held in a column or file: GPU snapshots, cluster specs, slot plans, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.config import leading_float, leading_long
from runledger.functions.env import SPEC
from runledger.schemas import GPU_SNAPSHOT, SLOT_NUMBERS, SLOT_PLAN
from runledger.sources.files import folder_by_folder


def gpu_rows(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per GPU of each XML snapshot, unit strings as numbers (-1 where missing)."""
    doc = F.from_xml(F.col(column), GPU_SNAPSHOT)
    gpus = docs.select(*keep, doc.alias("_d")).select(
        *keep, F.col("_d.driver_version").alias("driver_version"), F.explode("_d.gpu").alias("_g")
    )
    mem = lambda area, part: F.when(
        F.col(f"_g.{area}").isNotNull(), leading_long(f"_g.{area}.{part}")
    )
    return gpus.select(
        *keep,
        "driver_version",
        F.col("_g.product_name").alias("product_name"),
        F.col("_g.uuid").alias("uuid"),
        F.col("_g.minor_number").cast("int").alias("minor_number"),
        leading_float("_g.utilization.gpu_util").alias("utilization"),
        mem("fb_memory_usage", "used").alias("fb_used"),
        mem("fb_memory_usage", "free").alias("fb_free"),
        mem("bar1_memory_usage", "used").alias("bar1_used"),
        mem("bar1_memory_usage", "free").alias("bar1_free"),
    )


def read_gpu_snapshots(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return gpu_rows(files, "value", "path")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file below ``path``, its lines joined without line ends."""
    whole = lambda reader, paths: reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), without_line_ends("value").alias("text")
    )
    return folder_by_folder(spark, path, whole, "whole-files")


def without_line_ends(text: Column | str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, "\r\n|\n|\r", "")


def spec_members(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """Cluster spec JSON as rows (role, pos, host_port)."""
    return docs.select(*keep, F.explode(F.from_json(column, SPEC)).alias("role", "_h")).select(
        *keep, "role", F.posexplode("_h").alias("pos", "host_port")
    )


def plan_slots(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """Slot plan JSON as one row per slot."""
    slots = docs.select(*keep, F.inline(F.from_json(column, SLOT_PLAN)))
    return slots.withColumns({n: F.col(n).try_cast("int") for n in SLOT_NUMBERS})


# First four bytes of the archives known: three of zip, two of tar. Gzip shows in the first two.
ZIP_TAR = ["504B0304", "504B0506", "504B0708", "74657374", "75737461"]
GZIP = "1F8B"


def is_archive(content: Column | str) -> Column:
    """Does a file's content begin like a zip, tar or gzip archive."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 4))
    return (F.length(head) == 8) & (head.isin(ZIP_TAR) | head.startswith(GZIP))


def read_archive_flags(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive) of each file below ``path``."""
    flags = lambda reader, paths: reader.format("binaryFile").load(paths).select("path", is_archive("content").alias("archive"))
    return folder_by_folder(spark, path, flags, "archive-flags")
