"""Standing jobs: event ingest and the history mover.

Paths and checkpoint are the caller's. A job started again with its checkpoint takes up what is new; with another
checkpoint it is another stream, whose batches lie beside those written before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import build_history_name, parse_history_name
from runledger.operators.upkeep import finalise_killed, store_partition
from runledger.sinks.store import write_event_log
from runledger.streaming.running import for_each_batch


def ingest_events(events: DataFrame, path: str, checkpoint: str, period: str = "yyyy-MM-dd") -> None:
    """Append a stream of events to the log at ``path`` until drained; a batch that comes again replaces itself."""

    def step(batch: DataFrame, stream_id: str, n: int) -> None:
        write_event_log(batch, f"{path}/stream={stream_id}/batch={n}", period, "overwrite")

    for_each_batch(events, step, checkpoint)


def move_finished(
    names: DataFrame, killed: DataFrame, now_ms: int, store: str, index: str, checkpoint: str, zone: str = "UTC"
) -> DataFrame:
    """Mover: killed applications are finalised, finished ones placed by completion date, and
    the index of all seen applications, at ``index``, is returned: newest entry per application.

    ``names``: a stream of (name) of landing history files; ``killed``: app_id.
    """
    spark = names.sparkSession

    def step(batch: DataFrame, stream_id: str, n: int) -> None:
        at = f"stream={stream_id}/batch={n}"
        apps = batch.select(parse_history_name("name").alias("m")).select("m.*")
        settled = finalise_killed(apps, killed, now_ms)
        status = F.when(F.col("completed_ms") != -1, F.col("status"))
        named = settled.withColumn("name", build_history_name("app_id", "started_ms", "completed_ms", "usr", status))
        named.withColumn("seen_ms", F.unix_millis(F.current_timestamp())).write.mode("overwrite").parquet(f"{index}/{at}")
        placed = store_partition(spark.read.parquet(f"{index}/{at}").drop("seen_ms"), zone)
        placed.repartitionByRange("year", "month", "day", "name").write.mode("overwrite").partitionBy(
            "year", "month"
        ).parquet(f"{store}/{at}")

    for_each_batch(names, step, checkpoint)
    seen = spark.read.parquet(index)
    columns = [c for c in seen.columns if c not in ("app_id", "stream", "batch", "seen_ms")]
    order = F.struct("seen_ms", "batch", "started_ms")
    return seen.groupBy("app_id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("app_id", "r.*")
