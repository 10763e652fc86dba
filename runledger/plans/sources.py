"""Queries over sources and sinks. Files are first written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.history import flatten_events, to_event_union
from runledger.plans.registry import query
from runledger.plans.tables import Tables
from runledger.session import scratch_dir
from runledger.sinks import store
from runledger.sources import documents, eventlog, files

LOG_SQL = """
    SELECT k, file_pos, kind AS type, ts_ms AS timestamp,
           CASE WHEN kind LIKE 'TASK%' THEN role END AS task_type, CASE WHEN kind LIKE 'TASK%' THEN idx END AS task_index,
           CASE WHEN kind IN ('APPLICATION_INITED', 'TASK_STARTED') THEN host END AS host,
           CASE WHEN kind = 'TASK_FINISHED' THEN CASE exit_code WHEN 0 THEN 'SUCCEEDED' WHEN -105 THEN 'FINISHED' ELSE 'FAILED' END END AS status
    FROM event_log"""
LOG_COLUMNS = ["k", "file_pos", "type", "timestamp", "task_type", "task_index", "host", "status"]


def _stored_log(t: Tables, period: str = "yyyy-MM", buckets: int | None = None) -> str:
    path = scratch_dir(t.spark, "events")
    store.write_event_log(t.event_log, path, period, buckets=buckets)
    return path


@query(
    "S01_event_log_lookup",
    f"""{LOG_SQL} WHERE k IN (SELECT max(k) FROM apps UNION ALL SELECT min(k) FROM apps)""", ("event_log",),
)
def event_log_lookup(t: Tables):
    """The stored log, scanned for two applications: only the folders of their buckets are opened."""
    path = _stored_log(t, "yyyy", buckets=store.BUCKETS)
    ends = t.apps.agg(F.max("k").alias("a"), F.min("k").alias("b")).select(F.explode(F.array("a", "b")).alias("k"))
    log = eventlog.read_event_log(t.spark, path, t.event_log.schema, ends, buckets=store.BUCKETS)
    return flatten_events(to_event_union(log)).select(*LOG_COLUMNS)


@query("S01_event_log_scan", LOG_SQL, ("event_log",))
def event_log_scan(t: Tables):
    """The stored log, scanned for all applications of the task tables."""
    log = eventlog.read_event_log(t.spark, _stored_log(t), t.event_log.schema, t.apps.select("k"))
    return flatten_events(to_event_union(log)).select(*LOG_COLUMNS)


@query("K01_event_log_append", LOG_SQL, ("event_log",))
def event_log_append(t: Tables):
    return flatten_events(to_event_union(t.spark.read.parquet(_stored_log(t)))).select(*LOG_COLUMNS)


CONFIG_SQL = """
    SELECT app, key AS name, value, layer = 1 AS final, concat('layer', layer) AS source FROM app_config_layer
    WHERE NOT (key LIKE '%.memory' AND value = '7')"""


def _config_rows(t: Tables) -> DataFrame:
    return t.app_config_layer.select(
        "app",
        F.col("key").alias("name"),
        F.when(~(F.col("key").endswith(".memory") & (F.col("value") == "7")), F.col("value")).alias("value"),
        F.when(F.col("layer") == 1, "TRUE").otherwise("no").alias("final"),
        F.array(F.concat(F.lit("layer"), F.col("layer").cast("string")), F.lit("second")).alias("source"),
    )


def _written_config(t: Tables) -> str:
    path = scratch_dir(t.spark, "config")
    store.write_config(_config_rows(t), path)
    return path


@query("S02_config_scan", CONFIG_SQL, ("app_config_layer",))
def config_scan(t: Tables):
    rows = files.read_config(t.spark, _written_config(t), part_files=True)
    app = F.url_decode(F.url_decode(F.regexp_extract("dir", r"app=([^/]+)$", 1)))
    return rows.select(app.alias("app"), "name", "value", "final", "source")


@query(
    "S02_final_config",
    f"""c AS ({CONFIG_SQL}), n AS (SELECT DISTINCT app, CAST(right(app, 1) AS INT) % 2 = 0 AS has_final FROM c)
    SELECT app, name, CASE WHEN has_final THEN concat('final ', value) ELSE value END AS value, final, source FROM c JOIN n USING (app)
    WHERE NOT has_final OR name LIKE '%.memory'""",
    ("app_config_layer",),
)
def final_config(t: Tables):
    """Named files: every application has config.xml, those with an even number a final one too, which is read instead."""
    path, rows = scratch_dir(t.spark, "named"), _config_rows(t)
    store.write_config(rows, path)
    store.name_files(t.spark, path, "config.xml")
    even = F.right("app", F.lit(1)).cast("int") % 2 == 0
    final = rows.where(even & F.col("name").endswith(".memory")).withColumn("value", F.concat(F.lit("final "), F.col("value")))
    store.write_config(final, path, mode="append")
    store.name_files(t.spark, path, "job-final.xml")
    found = files.read_config(t.spark, path)
    app = F.url_decode(F.url_decode(F.regexp_extract("dir", r"app=([^/]+)$", 1)))
    return found.select(app.alias("app"), "name", "value", "final", "source")


@query("K02_config_write", CONFIG_SQL, ("app_config_layer",))
def config_write(t: Tables):
    rows = (
        t.spark.read.format("xml").option("rowTag", "property")
        .schema("name string, value string, final string, source array<string>, app string").load(_written_config(t))
    )
    return rows.where(F.col("value").isNotNull()).select(
        "app", "name", "value", (F.lower("final") == "true").alias("final"), F.get("source", F.lit(0)).alias("source")
    )


@query(
    "S03_directory_scan",
    "SELECT DISTINCT concat('app=', replace(p_brand, '#', '%23')) AS dir FROM part",
)
def directory_scan(t: Tables):
    found = files.read_job_directories(t.spark, _written_config(t), r"app=.*")
    return found.select(F.regexp_replace(F.url_decode(F.regexp_extract("dir", r"([^/]+)$", 1)), "#", "%23").alias("dir"))


@query("S09_landing_stream", "SELECT DISTINCT concat('app=', replace(p_brand, '#', '%23')) AS dir FROM part")
def landing_stream(t: Tables):
    """The directories found by the file stream, drained once."""
    out, check = scratch_dir(t.spark, "landing"), scratch_dir(t.spark, "landing-check")
    stream = files.stream_job_files(t.spark, _written_config(t), r"app=.*")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True)
    writer.start(out).awaitTermination()
    name = F.regexp_replace(F.url_decode(F.regexp_extract("dir", r"([^/]+)$", 1)), "#", "%23")
    return t.spark.read.parquet(out).select(name.alias("dir")).distinct()


@query(
    "S04_gpu_scan",
    """SELECT s_suppkey AS snap, '375.66' AS driver_version, 0 AS minor_number, CAST(s_suppkey % 101 AS FLOAT) AS utilization, s_suppkey % 7 AS fb_used, 8 + s_suppkey % 5 AS fb_free FROM supplier
    UNION ALL SELECT s_suppkey, '375.66', 1, CAST((s_suppkey * 3) % 101 AS FLOAT), s_suppkey % 3, 4 + s_suppkey % 9 FROM supplier""",
)
def gpu_scan(t: Tables):
    return documents.gpu_rows(t.gpu_xml, "xml", "snap").select(
        "snap", "driver_version", "minor_number", "utilization", "fb_used", "fb_free"
    )


@query(
    "S05_whole_text",
    "SELECT task, regexp_replace(text, '\\r\\n|\\n|\\r', '', 'g') AS text FROM logs",
    ("logs",),
)
def whole_text(t: Tables):
    return t.logs.select("task", documents.without_line_ends("text").alias("text"))


@query("S05_whole_files", f"SELECT task, regexp_replace(text, '\\r\\n|\\n|\\r', '', 'g') AS text FROM logs", ("logs",))
def whole_files(t: Tables):
    """One text file for each log, written by Spark and read whole."""
    path = scratch_dir(t.spark, "logs")
    store.write_files(t.logs, path, "task", "text")
    task = F.regexp_extract("path", r"/task=(\d+)[^/]*$", 1).cast("long")
    return documents.read_whole_files(t.spark, path).select(task.alias("task"), "text")


@query(
    "S06_cluster_spec_scan",
    """
    m AS (SELECT k, spec, unnest(json_keys(spec)) AS role FROM cluster_specs),
    h AS (SELECT k, role, CAST(json_extract(spec, concat('$."', role, '"')) AS VARCHAR[]) AS hosts FROM m)
    SELECT k, role, CAST(unnest(generate_series(0, len(hosts) - 1)) AS INT) AS pos, unnest(hosts) AS host_port FROM h""",
    ("cluster_specs",),
)
def cluster_spec_scan(t: Tables):
    return documents.spec_members(t.cluster_specs, "spec", "k")


SLOT_SQL = """
    SELECT o_orderkey AS k, concat('host', o_orderkey % 16) AS hostname, 0 AS rank, 0 AS "localRank", 0 AS "crossRank", 2 AS size, CAST(1 + o_orderkey % 2 AS INT) AS "localSize", CAST(2 - o_orderkey % 2 AS INT) AS "crossSize" FROM orders
    UNION ALL SELECT o_orderkey, concat('host', CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 16 ELSE (o_orderkey + 1) % 16 END), 1, CAST(o_orderkey % 2 AS INT), CAST(1 - o_orderkey % 2 AS INT), 2, CAST(1 + o_orderkey % 2 AS INT), CAST(2 - o_orderkey % 2 AS INT) FROM orders"""


@query("S07_slot_plan_scan", SLOT_SQL)
def slot_plan_scan(t: Tables):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    shared = k % 2 == 1
    slot = lambda host, rank, local, cross: F.concat(
        F.lit('{"hostname":"host'), text(host), F.lit(f'","rank":{rank},"localRank":'), text(local),
        F.lit(',"crossRank":'), text(cross), F.lit(',"size":2,"localSize":'), text(1 + k % 2),
        F.lit(',"crossSize":'), text(2 - k % 2), F.lit("}"),
    )
    second = F.when(shared, k % 16).otherwise((k + 1) % 16)
    plan = F.concat(
        F.lit("["), slot(k % 16, 0, F.lit(0), F.lit(0)), F.lit(","), slot(second, 1, k % 2, 1 - k % 2), F.lit("]")
    )
    return documents.plan_slots(t.raw("orders").select(k.alias("k"), plan.alias("plan")), "plan", "k")


# First bytes of five archive kinds and three files that are none.
HEADS = ["504B0304", "504B0506", "504B0708", "74657374", "75737461", "1F8B0800", "504B0000", "1F8C"]


@query(
    "S08_archive_flag",
    "SELECT p_partkey AS part, p_partkey % 8 < 6 AS archive FROM part",
)
def archive_flag(t: Tables):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.col("p_name").cast("binary"))))
    return t.raw("part").select(F.col("p_partkey").alias("part"), documents.is_archive(content).alias("archive"))


@query("S08_archive_files", "SELECT p_partkey AS part, p_partkey % 8 < 6 AS archive FROM part")
def archive_files(t: Tables):
    """One file for each part, written by Spark byte for byte, told apart by its first bytes."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex(F.col("p_name").cast("binary"))))
    path = scratch_dir(t.spark, "archives")
    store.write_files(t.raw("part").select(F.col("p_partkey").alias("part"), content.alias("value")), path, "part", "value")
    part = F.regexp_extract("path", r"/part=(\d+)[^/]*$", 1).cast("long")
    return documents.read_archive_flags(t.spark, path).select(part.alias("part"), "archive")
