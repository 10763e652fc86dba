"""Running streams: sources, drains, and sinks that resume.

State of a stream lies in the engine's own store, below the checkpoint. A stream started again with its checkpoint goes
on where it stopped; every batch is written under the identity of its stream, which the checkpoint keeps, and its number,
so a batch that comes again replaces itself and nothing that another stream wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from runledger.session import in_force, scratch_dir

#: In force while a stream starts; it keeps them, the session does not.
SETTINGS = {
    # A busy key sends a row per session and input partition, not all its rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
#: Keyed state with timers needs this store; other streams take the one that the session names.
KEYED = SETTINGS | {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: Stream joins hold all rows that may yet meet: on the executors' disks, with bounded memory beside the heap.
JOINED = KEYED | {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def settings(spark: SparkSession, keyed: bool = False, joined: bool = False):
    with in_force(spark, JOINED if joined else KEYED if keyed else SETTINGS):
        yield


def stream_of(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder (or file) as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_clock(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with their event time and a watermark ``delay`` behind the newest."""
    return rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def _ended(spark: SparkSession, running) -> None:
    """Wait for a stream. Shuffle files of past batches go when the driver's garbage does, which it may not collect for long."""
    while not running.awaitTermination(30):
        spark.sparkContext._jvm.System.gc()


def drain(stream: DataFrame, mode: str = "append", label: str = "stream", keyed: bool = False, joined: bool = False) -> DataFrame:
    """Run a stream until its source is empty and return what it wrote. ``keyed``: it holds an operator of ``streaming.keyed``,
    ``joined``: a join of streams."""
    spark = stream.sparkSession
    out = scratch_dir(spark, label)
    writer = stream.writeStream.outputMode(mode).format("parquet")
    writer = writer.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    with settings(spark, keyed, joined):
        running = writer.start(out)
    _ended(spark, running)
    return spark.read.schema(stream.schema).parquet(out)


def for_each_batch(stream: DataFrame, step: Callable[[DataFrame, str, int], None], checkpoint: str, mode: str = "append", keyed: bool = False) -> None:
    """Apply ``step(batch, stream id, number)`` to every micro-batch until the source is empty.

    A batch may come again after a failure, with the same identity and number: steps overwrite by both.
    """
    spark = stream.sparkSession

    def numbered(batch: DataFrame, n: int) -> None:
        step(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), n)

    writer = stream.writeStream.outputMode(mode).foreachBatch(numbered).option("checkpointLocation", checkpoint)
    with settings(spark, keyed):
        running = writer.trigger(availableNow=True).start()
    _ended(spark, running)


def changes_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", keyed: bool = False) -> None:
    """Write the rows that each batch changed or added to ``path``, as the stream runs."""

    def step(batch: DataFrame, stream_id: str, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/stream={stream_id}/batch={n}")

    for_each_batch(stream, step, checkpoint, mode, keyed)


def changes_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`changes_to` wrote, with the ``stream`` and the number of its ``batch``."""
    return spark.read.schema(StructType(list(schema.fields)).add("stream", "string").add("batch", LongType())).parquet(path)


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in changes.columns if c not in (*keys, "stream", "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


def state_of(stream: DataFrame, keys: list[str], label: str = "state", keyed: bool = False) -> DataFrame:
    """Run a stream of changes until its source is empty and return the last row of each key."""
    spark = stream.sparkSession
    path = scratch_dir(spark, label)
    changes_to(stream, path, f"{path}-state", keyed=keyed)
    return newest(changes_of(spark, path, stream.schema), keys)
