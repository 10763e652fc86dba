"""Queries over the scalar functions (P) and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import config, env, links, names, predicates
from runledger.operators.history import container_rows, flatten_events, to_event_union
from runledger.operators.settings import merge_layers
from runledger.operators.tasks import unregistered_tasks
from runledger.plans.registry import query
from runledger.plans.tables import Tables
from runledger.sources.documents import gpu_rows

KEYS = config.Keys("job")


def with_container(t: Tables):
    """The event log with a container id per event."""
    return t.event_log.withColumn(
        "container", F.concat_ws("_", F.lit("container"), F.col("k").cast("string"), F.col("file_pos").cast("string"))
    )


@query(
    "P01_parse_file_name",
    """
    b AS (SELECT k, name, string_split(regexp_replace(split_part(name, '.', 1), '-+$', ''), '-') AS p,
                 ends_with(name, 'inprogress') AS running FROM file_names)
    SELECT k, p[1] AS app_id, TRY_CAST(p[2] AS BIGINT) AS started_ms,
           CASE WHEN running THEN -1 ELSE TRY_CAST(p[3] AS BIGINT) END AS completed_ms,
           CASE WHEN running THEN p[3] ELSE p[4] END AS usr,
           CASE WHEN running THEN 'RUNNING' ELSE p[5] END AS status FROM b""",
    ("file_names",),
)
def parse_file_name(t: Tables):
    return t.file_names.select("k", names.parse_history_name("name").alias("m")).select("k", "m.*")


@query(
    "P02_validate_file_name",
    """
    b AS (SELECT k, name, string_split(split_part(name, '.', 1), '-') AS p,
                 ends_with(name, 'inprogress') AS running FROM file_names),
    c AS (SELECT k, CASE
        WHEN name = '' THEN 'empty' WHEN position('.' IN name) = 0 THEN 'no extension'
        WHEN len(p) < 3 THEN 'missing fields'
        WHEN NOT running AND len(p) <> 5 THEN 'field count'
        WHEN NOT regexp_full_match(p[1], 'application_[0-9]+_[0-9]+') THEN 'id'
        WHEN NOT regexp_full_match(p[2], '[0-9]+') THEN 'started'
        WHEN NOT running AND NOT regexp_full_match(p[3], '[0-9]+') THEN 'completed'
        WHEN (CASE WHEN running THEN p[3] ELSE p[4] END) <> lower(CASE WHEN running THEN p[3] ELSE p[4] END) THEN 'user'
        WHEN NOT running AND p[5] <> upper(p[5]) THEN 'status' END AS reason FROM b)
    SELECT k, reason IS NULL AS valid, reason FROM c""",
    ("file_names",),
)
def validate_file_name(t: Tables):
    fault = names.history_name_fault("name")
    return t.file_names.select("k", names.is_valid_history_name("name").alias("valid"), fault.alias("reason"))


@query(
    "P03_build_file_name",
    """
    SELECT k, concat(app_id, '-', started_ms, CASE WHEN completed_ms = -1 THEN '' ELSE concat('-', completed_ms) END,
           '-', usr, CASE WHEN completed_ms = -1 THEN '.jhist.inprogress' ELSE concat('-', status, '.jhist') END) AS name
    FROM apps""",
    ("apps",),
)
def build_file_name(t: Tables):
    status = F.when(F.col("completed_ms") != -1, F.col("status"))
    return t.apps.select(
        "k", names.build_history_name("app_id", "started_ms", "completed_ms", "usr", status).alias("name")
    )


@query(
    "P04_flatten_event",
    """
    SELECT k, file_pos, kind AS type, ts_ms AS timestamp,
           CASE WHEN kind LIKE 'APPLICATION%' THEN concat('application_', k) END AS application_id,
           CASE WHEN kind LIKE 'TASK%' THEN role END AS task_type,
           CASE WHEN kind LIKE 'TASK%' THEN idx END AS task_index,
           CASE WHEN kind IN ('APPLICATION_INITED', 'TASK_STARTED') THEN host END AS host,
           CASE WHEN kind = 'TASK_FINISHED' THEN CASE exit_code WHEN 0 THEN 'SUCCEEDED' WHEN -105 THEN 'FINISHED' ELSE 'FAILED' END END AS status
    FROM event_log""",
    ("event_log",),
)
def flatten_event(t: Tables):
    return flatten_events(to_event_union(t.event_log)).select(
        "k", "file_pos", "type", "timestamp", "application_id", "task_type", "task_index", "host", "status"
    )


@query(
    "P05_container_log_link",
    """
    SELECT k, role, idx, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'NA'
       ELSE concat('http://', host, ':8042/node/containerlogs/', role, '_', idx, '/user', k % 7) END AS link FROM tasks""",
    ("tasks",),
)
def container_log_link(t: Tables):
    k = F.col("k")
    usr = F.when(k % 3 != 0, F.concat(F.lit("user"), (k % 7).cast("string")))
    address = F.when(k % 5 == 0, "0.0.0.0").otherwise("0.0.0.0:8042")
    container = F.concat_ws("_", "role", F.col("idx").cast("string"))
    return t.tasks.select("k", "role", "idx", links.log_link("host", container, usr, address).alias("link"))


@query(
    "P06_event_log_row",
    """
    SELECT k, file_pos, CASE WHEN kind IN ('APPLICATION_INITED', 'TASK_STARTED') THEN host END AS host,
           CASE WHEN kind IN ('APPLICATION_INITED', 'TASK_STARTED') THEN concat('container_', k, '_', file_pos) END AS container
    FROM event_log""",
    ("event_log",),
)
def event_log_row(t: Tables):
    return container_rows(with_container(t)).select("k", "file_pos", "host", "container")


@query(
    "P07_app_links",
    """
    SELECT k, concat('/jobs/', app_id) AS job_link, concat('/config/', app_id) AS config_link,
           concat('http://rm:8088/cluster/app/', app_id) AS rm_link,
           concat('Events=/jobs/', app_id, ',Logs=/logs/', app_id) AS page_links FROM apps""",
    ("apps",),
)
def app_links(t: Tables):
    page = links.app_links("app_id")
    return t.apps.select(
        "k",
        page["Events"].alias("job_link"),
        links.config_link("app_id").alias("config_link"),
        links.cluster_app_url("app_id", "rm:8088").alias("rm_link"),
        F.array_join(
            F.transform(F.map_entries(page), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        ).alias("page_links"),
    )


@query(
    "P08_normalise_url",
    """
    SELECT page_id, CASE WHEN bare LIKE 'http%' THEN bare ELSE concat('http://', bare) END AS url,
           concat('http://', host, '/node/containerlogs/page_', page_id, '/usr') AS task_url,
           concat(CASE WHEN bare LIKE 'http%' THEN bare ELSE concat('http://', bare) END, '/jobs/page_', page_id) AS portal_link
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS bare,
                 regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) p""",
)
def normalise_url(t: Tables):
    pages = t.raw("pages").select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.col("url"))
        .otherwise(F.regexp_replace("url", "^https?://", ""))
        .alias("bare"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )
    page = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    url = links.with_scheme("bare")
    return pages.select(
        "page_id", url.alias("url"), links.task_url("host", page, F.lit("usr")).alias("task_url"),
        links.portal_link(url, page).alias("portal_link"),
    )


@query(
    "P09_memory_to_mb",
    """
    SELECT app, layer, pos, value, CASE WHEN value LIKE '%g' THEN TRY_CAST(replace(value, 'g', '') AS BIGINT) * 1024
       WHEN value LIKE '%M' THEN TRY_CAST(replace(value, 'M', '') AS BIGINT) ELSE TRY_CAST(value AS BIGINT) END AS mb
    FROM app_config_layer WHERE key LIKE '%.memory'""",
    ("app_config_layer",),
)
def memory_to_mb(t: Tables):
    return t.app_config_layer.where(F.col("key").endswith(".memory")).select(
        "app", "layer", "pos", "value", config.memory_mb("value").alias("mb")
    )


@query(
    "P10_key_value_map",
    """
    i AS (SELECT p_partkey AS part, unnest([
              concat('  BRAND=', p_brand, ' '), p_name, concat('SIZE=', p_size, '=x'), concat('BRAND=', p_type), 'EMPTY=']) AS item,
              generate_subscripts([1,2,3,4,5], 1) AS pos FROM part),
    e AS (SELECT part, pos, CASE WHEN position('=' IN trim(item)) = 0 THEN trim(item) ELSE split_part(trim(item), '=', 1) END AS key,
              CASE WHEN position('=' IN trim(item)) = 0 THEN '' ELSE substr(trim(item), position('=' IN trim(item)) + 1) END AS value FROM i)
    SELECT part, key, max_by(value, pos) AS value FROM e GROUP BY part, key""",
)
def key_value_map(t: Tables):
    items = F.array(
        F.concat(F.lit("  BRAND="), "p_brand", F.lit(" ")),
        F.col("p_name"),
        F.concat(F.lit("SIZE="), F.col("p_size").cast("string"), F.lit("=x")),
        F.concat(F.lit("BRAND="), "p_type"),
        F.lit("EMPTY="),
    )
    return t.raw("part").select(
        F.col("p_partkey").alias("part"), F.explode(config.parse_key_values(items))
    )


@query(
    "P11_host_port",
    """
    SELECT k, role, idx, regexp_full_match(txt, '[\\w.\\-]+:[0-9]+') AS valid,
           CASE WHEN k % 4 = 0 THEN NULL ELSE host END AS host,
           CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(greatest(k % 9 - 3, 0) AS VARCHAR) END AS port
    FROM (SELECT k, role, idx, host, CASE WHEN k % 4 = 0 THEN concat(host, ' port') ELSE concat(host, ':', greatest(k % 9 - 3, 0)) END AS txt FROM tasks) x""",
    ("tasks",),
)
def host_port(t: Tables):
    k = F.col("k")
    text = F.when(k % 4 == 0, F.concat("host", F.lit(" port"))).otherwise(
        config.host_port("host", k % 9 - 3)
    )
    return t.tasks.select("k", "role", "idx", config.split_host_port(text).alias("hp")).select(
        "k", "role", "idx", F.col("hp").isNotNull().alias("valid"), "hp.host", "hp.port"
    )


@query(
    "P12_task_id",
    """
    SELECT k, concat(role, ':', idx) AS task_id, CASE WHEN k % 6 = 0 THEN NULL ELSE role END AS role,
           CASE WHEN k % 6 = 0 THEN NULL ELSE idx END AS idx FROM tasks""",
    ("tasks",),
)
def task_id(t: Tables):
    tid = names.task_id("role", "idx")
    damaged = F.when(F.col("k") % 6 == 0, F.concat(tid, F.lit("x"))).otherwise(tid)
    return t.tasks.select("k", tid.alias("task_id"), names.parse_task_id(damaged).alias("p")).select(
        "k", "task_id", "p.role", "p.idx"
    )


@query(
    "P13_last_component",
    """
    SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS last,
           regexp_full_match(regexp_extract(url, '([^/]+)/*$', 1), '[0-9]+') AS is_number FROM pages""",
)
def last_component(t: Tables):
    return t.raw("pages").select(
        "page_id", names.last_component("url").alias("last"),
        names.is_job_folder("url", "[0-9]+").alias("is_number"),
    )


@query(
    "P14_date_directory",
    """
    SELECT k, strftime(epoch_ms(started_ms + k * 60000), '%Y/%m/%d') AS utc,
           strftime((epoch_ms(started_ms + k * 60000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y/%m/%d') AS west
    FROM apps""",
    ("apps",),
)
def date_directory(t: Tables):
    at = F.col("started_ms") + F.col("k") * 60000
    return t.apps.select(
        "k", names.date_directory(at).alias("utc"), names.date_directory(at, "America/Los_Angeles").alias("west")
    )


@query(
    "P15_display_time",
    """
    SELECT k, concat(strftime(epoch_ms(started_ms + k), '%d %b %Y %H:%M:%S:%g'), ' +0000') AS started,
           CASE WHEN completed_ms = -1 THEN '-' ELSE concat(strftime(epoch_ms(completed_ms), '%d %b %Y %H:%M:%S:%g'), ' +0000') END AS completed
    FROM apps""",
    ("apps",),
)
def display_time(t: Tables):
    return t.apps.select(
        "k", names.display_time(F.col("started_ms") + F.col("k")).alias("started"),
        names.display_time("completed_ms").alias("completed"),
    )


DURATION_SQL = """concat(CASE WHEN {s} // 86400 <> 0 THEN concat({s} // 86400, 'D ') ELSE '' END,
           CASE WHEN {s} // 3600 % 24 <> 0 THEN concat({s} // 3600 % 24, 'H ') ELSE '' END,
           CASE WHEN {s} // 60 % 60 <> 0 THEN concat({s} // 60 % 60, 'm ') ELSE '' END,
           CASE WHEN {s} % 60 <> 0 THEN concat({s} % 60, 's') ELSE '' END)"""


@query(
    "P16_duration_text",
    f"""SELECT k, {DURATION_SQL.format(s='ms // 1000')} AS duration
    FROM (SELECT k, CASE WHEN completed_ms = -1 THEN k * 977 ELSE (completed_ms - started_ms) * (k % 9) END AS ms FROM apps) a""",
    ("apps",),
)
def duration_text(t: Tables):
    ms = F.when(F.col("completed_ms") == -1, F.col("k") * 977).otherwise(
        (F.col("completed_ms") - F.col("started_ms")) * (F.col("k") % 9)
    )
    return t.apps.select("k", names.duration_text(ms).alias("duration"))


def parsed_specs(t: Tables):
    return t.cluster_specs.select("k", "role", "idx", env.cluster_spec("spec").alias("m"))


@query(
    "P17_tf_config",
    """
    m AS (SELECT k, role, idx, spec, unnest(json_keys(spec)) AS name FROM cluster_specs),
    h AS (SELECT k, role, idx, name, unnest(CAST(json_extract(spec, concat('$."', name, '"')) AS VARCHAR[])) AS host_port,
                 generate_subscripts(CAST(json_extract(spec, concat('$."', name, '"')) AS VARCHAR[]), 1) AS pos FROM m
          WHERE name <> 'tensorboard' AND (role = 'evaluator' OR lower(name) <> 'evaluator'))
    SELECT k, role AS task_type, idx AS task_index, name AS member, CAST(pos - 1 AS INT) AS pos, host_port FROM h""",
    ("cluster_specs",),
)
def tf_config(t: Tables):
    text = env.tf_config(F.col("m"), "role", "idx")
    back = F.from_json(text, f"cluster {env.SPEC}, task struct<type:string,index:int>")
    return (
        parsed_specs(t).select("k", back.alias("c"))
        .select("k", F.col("c.task.type").alias("task_type"), F.col("c.task.index").alias("task_index"),
                F.explode("c.cluster").alias("member", "hosts"))
        .select("k", "task_type", "task_index", "member", F.posexplode("hosts").alias("pos", "host_port"))
    )


@query(
    "P18_rank_env",
    """
    SELECT k, concat('tcp://', spec->>'$.worker[0]') AS init_method, CAST(idx AS VARCHAR) AS rank, '3' AS world
    FROM cluster_specs""",
    ("cluster_specs",),
)
def rank_env(t: Tables):
    e = env.rank_env(F.col("m"), "idx", F.lit(3))
    return parsed_specs(t).select("k", e.alias("e")).select("k", "e.*")


@query(
    "P19_parameter_server_env",
    """
    SELECT k, CASE WHEN k % 5 = 0 THEN NULL ELSE role END AS role,
           CASE WHEN k % 5 = 0 THEN NULL ELSE split_part(spec->>'$.scheduler[0]', ':', 1) END AS root_uri,
           CASE WHEN k % 5 = 0 THEN NULL ELSE split_part(spec->>'$.scheduler[0]', ':', 2) END AS root_port,
           CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(coalesce(json_array_length(spec, '$.server'), 0) AS INT) END AS servers,
           CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(coalesce(json_array_length(spec, '$.worker'), 0) AS INT) END AS workers
    FROM cluster_specs""",
    ("cluster_specs",),
)
def parameter_server_env(t: Tables):
    e = env.parameter_server_env(F.col("m"), "role")
    return parsed_specs(t).select("k", e.alias("e")).select("k", "e.*")


@query(
    "P20_unit_strings",
    """
    SELECT s_suppkey AS snap, CASE WHEN s_suppkey % 7 = 0 THEN CAST(-1 AS FLOAT) ELSE CAST(concat(s_suppkey % 101, '.', s_suppkey % 10) AS FLOAT) END AS util,
           CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE CAST(s_suppkey * 17 AS BIGINT) END AS mem FROM supplier""",
)
def unit_strings(t: Tables):
    s = F.col("s_suppkey")
    util = F.when(
        s % 7 != 0, F.concat((s % 101).cast("string"), F.lit("."), (s % 10).cast("string"), F.lit(" %"))
    )
    mem = F.when(s % 5 != 0, F.concat((s * 17).cast("string"), F.lit(" MiB")))
    return t.raw("supplier").select(
        s.alias("snap"), config.leading_float(util).alias("util"), config.leading_long(mem).alias("mem")
    )


@query(
    "P21_gpu_memory_percent",
    """
    SELECT s_suppkey AS snap, 0 AS minor, round(CAST(s_suppkey % 7 AS DOUBLE) / (s_suppkey % 7 + 8 + s_suppkey % 5) * 100, 6) AS fb_percent FROM supplier
    UNION ALL SELECT s_suppkey, 1, round(CAST(s_suppkey % 3 AS DOUBLE) / (s_suppkey % 3 + 4 + s_suppkey % 9) * 100, 6) FROM supplier""",
)
def gpu_memory_percent(t: Tables):
    return gpu_rows(t.gpu_xml, "xml", "snap").select(
        "snap", F.col("minor_number").cast("int").alias("minor"),
        F.round(config.percent_used("fb_used", "fb_free"), 6).alias("fb_percent"),
    )


@query(
    "P22_resource_spec",
    """
    b AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ARCHIVE' ELSE 'FILE' END AS type, url FROM pages)
    SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE url END AS source,
           CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN concat('local', page_id) ELSE regexp_extract(url, '([^/]+)/*$', 1) END AS local_name,
           CASE WHEN page_id % 11 = 0 THEN NULL ELSE type END AS type FROM b""",
)
def resource_spec(t: Tables):
    p = F.col("page_id")
    local = F.concat(F.lit("::local"), p.cast("string"))
    text = F.concat(
        "url",
        F.when(p % 11 == 0, F.concat(local, local)).when(p % 3 == 0, local).otherwise(""),
        F.when(p % 2 == 0, F.lit("#archive")).otherwise(""),
    )
    return t.raw("pages").select("page_id", config.parse_resource(text).alias("r")).select("page_id", "r.*")


@query(
    "P23_key_fields",
    """
    k AS (SELECT p_partkey AS part, unnest([concat('job.', lower(p_type), '.instances'), concat('job.', p_type, '.instances'),
             concat('job.task.max-total-', lower(p_type)), concat('job.application.group.', p_type),
             concat('job.application.dependency.', lower(p_type), '.timeout.after.', p_type), concat('x.job.', lower(p_type), '.instances')]) AS key FROM part)
    SELECT part, key, nullif(regexp_extract(key, '^job\\.([a-z]+)\\.instances$', 1), '') AS role,
           nullif(regexp_extract(key, '^job\\.task\\.max-total-([a-z]+)$', 1), '') AS resource,
           nullif(regexp_extract(key, '^job\\.application\\.group\\.([A-Za-z]+)$', 1), '') AS grp,
           nullif(regexp_extract(key, '^job\\.application\\.dependency\\.([A-Za-z]+)\\.timeout\\.after\\.([A-Za-z]+)$', 1), '') AS waiting,
           nullif(regexp_extract(key, '^job\\.application\\.dependency\\.([A-Za-z]+)\\.timeout\\.after\\.([A-Za-z]+)$', 2), '') AS awaited
    FROM k""",
)
def key_fields(t: Tables):
    low, raw = F.lower("p_type"), F.col("p_type")
    keys = F.array(
        F.concat(F.lit("job."), low, F.lit(".instances")),
        F.concat(F.lit("job."), raw, F.lit(".instances")),
        F.concat(F.lit("job.task.max-total-"), low),
        F.concat(F.lit("job.application.group."), raw),
        F.concat(F.lit("job.application.dependency."), low, F.lit(".timeout.after."), raw),
        F.concat(F.lit("x.job."), low, F.lit(".instances")),
    )
    return t.raw("part").select(F.col("p_partkey").alias("part"), F.explode(keys).alias("key")).select(
        "part", "key", KEYS.role("key").alias("role"), KEYS.capped_resource("key").alias("resource"),
        KEYS.group("key").alias("grp"), KEYS.waiting_role("key").alias("waiting"),
        KEYS.awaited_group("key").alias("awaited"),
    )


@query(
    "P24_layered_config",
    """
    h AS (SELECT app, key, max_by(value, pos) FILTER (WHERE layer = 0) AS d, max_by(value, pos) FILTER (WHERE layer = 1) AS f,
                 max_by(value, pos) FILTER (WHERE layer = 2) AS c, max_by(value, pos) FILTER (WHERE layer = 3) AS s
          FROM app_config_layer GROUP BY app, key)
    SELECT app, key, CASE WHEN key LIKE '%.instances' AND c IS NOT NULL AND coalesce(f, d) IS NOT NULL THEN concat(coalesce(f, d), ',', c)
       ELSE coalesce(c, s, f, d) END AS value FROM h""",
    ("app_config_layer",),
)
def layered_config(t: Tables):
    return merge_layers(t.app_config_layer, F.col("key").endswith(".instances"))


@query(
    "P25_exit_status",
    """
    SELECT k, role, idx, CASE WHEN exit_code IS NULL THEN 'RUNNING' WHEN exit_code = 0 THEN 'SUCCEEDED'
       WHEN exit_code = -105 THEN 'FINISHED' ELSE 'FAILED' END AS status FROM tasks""",
    ("tasks",),
)
def exit_status(t: Tables):
    return t.tasks.select("k", "role", "idx", predicates.task_status("exit_code").alias("status"))


@query(
    "P26_reprefix",
    """
    SELECT app, layer, pos, concat('am.', substr(key, 5)) AS key, value,
           concat(CASE WHEN value = '0' THEN '' ELSE concat(value, ' ') END, '-Xmx1g') AS options
    FROM app_config_layer WHERE key LIKE 'job.%'""",
    ("app_config_layer",),
)
def reprefix(t: Tables):
    own = F.when(F.col("value") == "0", "").otherwise(F.col("value"))
    return (
        t.app_config_layer.select(
            "app", "layer", "pos", config.reprefixed("key", "job.", "am.").alias("key"), "value",
            config.join_options(own, F.lit("-Xmx1g")).alias("options"),
        )
        .where(F.col("key").isNotNull())
    )


# --- predicates -----------------------------------------------------------------------------


@query(
    "F01_in_progress",
    """
    SELECT k, name, NOT ends_with(name, 'jhist') AS in_progress FROM file_names WHERE name LIKE '%jhist%'""",
    ("file_names",),
)
def in_progress(t: Tables):
    return t.file_names.where(names.is_history_file("name")).select(
        "k", "name", names.in_progress("name").alias("in_progress")
    )


@query(
    "F02_container_rows",
    """
    SELECT k, file_pos, host, concat('container_', k, '_', file_pos) AS container FROM event_log
    WHERE kind IN ('APPLICATION_INITED', 'TASK_STARTED')""",
    ("event_log",),
)
def containers(t: Tables):
    return (
        container_rows(with_container(t))
        .where(F.col("container").isNotNull())
        .select("k", "file_pos", "host", "container")
    )


@query(
    "F03_monitored_role",
    """
    SELECT k, role, idx, role NOT IN ('ps', 'tensorboard') AS monitored, role = 'ps' AS untracked FROM tasks""",
    ("tasks",),
)
def monitored_role(t: Tables):
    return t.tasks.select(
        "k", "role", "idx", predicates.is_monitored("role", ["ps"]).alias("monitored"),
        predicates.is_untracked("role", ["ps"]).alias("untracked"),
    )


@query(
    "F05_illegal_keys",
    """
    SELECT app, key, count(*) AS entries, bool_or(regexp_matches(key, 'job.promo\\.([a-z]+)') OR regexp_matches(key, 'large')) AS illegal
    FROM app_config_layer GROUP BY app, key""",
    ("app_config_layer",),
)
def illegal_keys(t: Tables):
    deny = [r"job.promo\.([a-z]+)", "large"]
    return (
        t.app_config_layer.groupBy("app", "key")
        .agg(F.count(F.lit(1)).alias("entries"))
        .withColumn("illegal", predicates.breaks_rule("key", deny))
    )


@query(
    "F06_unregistered",
    "SELECT k, role, idx FROM tasks WHERE idx = 1 AND host = 'host3' OR exit_code IS NULL AND host = 'host5'",
    ("tasks",),
)
def unregistered(t: Tables):
    return unregistered_tasks(launched_tasks(t)).select("k", "role", "idx")


def launched_tasks(t: Tables):
    """Tasks with the launch columns some of the operators need: a host that is unknown until
    the task registers."""
    late = ((F.col("idx") == 1) & (F.col("host") == "host3")) | (
        F.col("exit_code").isNull() & (F.col("host") == "host5")
    )
    return t.tasks.withColumn("host", F.when(~late, F.col("host")))


@query(
    "F07_running_failed",
    """
    SELECT k, role, idx, exit_code IS NULL AS running, coalesce(exit_code NOT IN (0, -105), false) AS failed FROM tasks
    WHERE exit_code IS NULL OR exit_code NOT IN (0, -105)""",
    ("tasks",),
)
def running_failed(t: Tables):
    running, failed = ~predicates.is_completed(), predicates.is_failed()
    return t.tasks.select("k", "role", "idx", running.alias("running"), failed.alias("failed")).where(
        F.col("running") | F.col("failed")
    )


@query(
    "F09_column_search",
    """
    SELECT k, app_id, usr, status FROM apps WHERE lower(usr) LIKE '%ild%' AND lower(status) LIKE '%fail%' AND app_id LIKE '%7%'""",
    ("apps",),
)
def column_search(t: Tables):
    return t.apps.where(
        predicates.contains_text({"usr": "ILD", "status": "Fail", "app_id": "7"})
    ).select("k", "app_id", "usr", "status")
