"""Queries over configuration: requests, limits, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import sets, settings
from runledger.plans.registry import query
from runledger.plans.tables import Tables

# One value per key: the merged configuration the request queries start from.
MERGED_SQL = """
    h AS (SELECT app, key, max_by(value, pos) FILTER (WHERE layer = 0) AS d, max_by(value, pos) FILTER (WHERE layer = 1) AS f,
                 max_by(value, pos) FILTER (WHERE layer = 2) AS c, max_by(value, pos) FILTER (WHERE layer = 3) AS s
          FROM app_config_layer GROUP BY app, key),
    m AS (SELECT app, key, coalesce(c, s, f, d) AS value FROM h)"""
REQUEST_SQL = f"""{MERGED_SQL},
    req AS (SELECT app, regexp_extract(key, '^job\\.([a-z]+)\\.[a-z]+$', 1) AS role,
               coalesce(TRY_CAST(max(value) FILTER (WHERE key LIKE '%.instances') AS INT), 0) AS instances,
               CASE WHEN max(value) FILTER (WHERE key LIKE '%.memory') LIKE '%g' THEN CAST(replace(max(value) FILTER (WHERE key LIKE '%.memory'), 'g', '') AS BIGINT) * 1024
                    ELSE CAST(replace(max(value) FILTER (WHERE key LIKE '%.memory'), 'M', '') AS BIGINT) END AS memory_mb,
               1 AS vcores, 0 AS gpus FROM m GROUP BY app, role HAVING instances > 0)"""


def merged(t: Tables) -> DataFrame:
    return settings.merge_layers(t.app_config_layer, F.lit(False))


def requests(t: Tables) -> DataFrame:
    return settings.container_requests(merged(t)).drop("node_label", "placement_spec", "allocation_tags")


@query("G15_roles", f"{MERGED_SQL} SELECT DISTINCT app, regexp_extract(key, '^job\\.([a-z]+)\\.instances$', 1) AS role FROM m WHERE key LIKE '%.instances'", ("app_config_layer",))
def roles(t: Tables):
    return settings.roles(merged(t))


@query("G07_container_requests", f"{REQUEST_SQL} SELECT * FROM req", ("app_config_layer",))
def container_requests(t: Tables):
    return requests(t)


def _more_settings(t: Tables) -> DataFrame:
    """Labels, placements, tags and stages beside the merged settings: key and value by the first part of each role."""
    first = t.raw("part").groupBy(F.col("p_brand").alias("app"), F.lower("p_type").alias("role")).agg(F.min("p_partkey").alias("p"))
    p = F.col("p")
    number = lambda text, n: F.concat(F.lit(text), (p % n).cast("string"))
    setting = lambda name, when, value: F.struct(F.concat(F.lit("job."), F.col("role"), F.lit(f".{name}")).alias("key"), F.when(when, value).alias("value"))
    own = F.array(
        setting("node-label", p % 2 == 0, number("label", 5)), setting("placement-spec", p % 3 == 0, number("spec", 7)),
        setting("allocation-tags", p % 4 == 0, F.lit("x,y")),
    )
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("role")))), ", ")
    apps = first.groupBy("app").agg(
        names(p % 2 == 1).alias("prepare"), names(p % 2 == 0).alias("training"), names(p % 10 == 1).alias("off"), F.min("p").alias("p"))
    entry = lambda key, value: F.struct(F.lit(f"job.{key}").alias("key"), value.alias("value"))
    shared = F.array(
        entry("containers.placement-spec", F.when(p % 2 == 0, "any")), entry("containers.allocation-tags", F.when(p % 3 == 0, "z")),
        entry("application.prepare-stage", F.when(p % 5 != 0, F.col("prepare"))), entry("application.training-stage", F.col("training")),
        entry("application.untracked.jobtypes", F.col("off")),
    )
    return first.select("app", F.inline(own)).unionByName(apps.select("app", F.inline(shared))).where("value IS NOT NULL")


@query(
    "G07_full_requests",
    f"""{REQUEST_SQL},
    f AS (SELECT p_brand AS app, lower(p_type) AS role, min(p_partkey) AS p FROM part GROUP BY 1, 2),
    a AS (SELECT app, list(role ORDER BY role) AS roles, coalesce(list(role ORDER BY role) FILTER (p % 2 = 1), []) AS odd,
                 coalesce(list(role ORDER BY role) FILTER (p % 2 = 0), []) AS training, coalesce(list(role) FILTER (p % 10 = 1), []) AS off, min(p) AS p FROM f GROUP BY app),
    b AS (SELECT *, CASE WHEN p % 5 <> 0 THEN odd ELSE [] END AS asked FROM a),
    c AS (SELECT *, CASE WHEN len(asked) = 0 AND len(training) > 0 THEN list_filter(roles, lambda x: NOT list_contains(training, x)) ELSE asked END AS prepare,
                 CASE WHEN len(training) = 0 AND len(asked) > 0 THEN list_filter(roles, lambda x: NOT list_contains(asked, x)) ELSE training END AS train FROM b)
    SELECT app, role, instances, memory_mb, vcores, gpus, CAST(row_number() OVER (PARTITION BY app ORDER BY role) - 1 AS INT) AS priority,
           CASE WHEN f.p % 2 = 0 THEN concat('label', f.p % 5) END AS node_label,
           CASE WHEN len(prepare) + len(train) = len(roles) OR len(prepare) + len(train) = 0 THEN
             CASE WHEN list_contains(train, role) THEN array_to_string(list_filter(prepare, lambda x: NOT list_contains(off, x)), ',') ELSE '' END END AS depends_on,
           CASE WHEN f.p % 3 = 0 THEN concat('spec', f.p % 7) WHEN c.p % 2 = 0 THEN 'any' END AS placement_spec,
           CASE WHEN f.p % 4 = 0 THEN 'x|y' WHEN c.p % 3 = 0 THEN 'z' END AS allocation_tags
    FROM req JOIN f USING (app, role) JOIN c USING (app)""",
    ("app_config_layer",),
)
def full_requests(t: Tables):
    asked = settings.full_requests(merged(t).unionByName(_more_settings(t)))
    return asked.withColumns({"depends_on": F.array_join("depends_on", ","), "allocation_tags": F.array_join("allocation_tags", "|")})


@query(
    "W02_priorities",
    f"{REQUEST_SQL} SELECT app, role, CAST(row_number() OVER (PARTITION BY app ORDER BY role) - 1 AS INT) AS priority FROM req",
    ("app_config_layer",),
)
def priorities(t: Tables):
    # One row per role of an application: never too many for one task.
    return settings.priorities(requests(t), hot=False).select("app", "role", "priority")


@query(
    "G06_resource_totals",
    f"""{REQUEST_SQL}
    SELECT app, 'memory' AS resource, CAST(sum(memory_mb * instances) AS BIGINT) AS total FROM req GROUP BY app
    UNION ALL SELECT app, 'vcores', CAST(sum(vcores * instances) AS BIGINT) FROM req GROUP BY app
    UNION ALL SELECT app, 'gpus', CAST(sum(gpus * instances) AS BIGINT) FROM req GROUP BY app
    UNION ALL SELECT app, 'instances', CAST(sum(instances) AS BIGINT) FROM req GROUP BY app""",
    ("app_config_layer",),
)
def resource_totals(t: Tables):
    return settings.resource_totals(requests(t))


@query(
    "J09_limit_violations",
    f"""{REQUEST_SQL},
    lim AS (SELECT p_brand AS app, lower(p_type) AS role, max(p_partkey) % 5 - 1 AS max_allowed FROM part GROUP BY p_brand, p_type),
    tot AS (SELECT app, CAST(sum(memory_mb * instances) AS BIGINT) AS total FROM req GROUP BY app),
    tl AS (SELECT p_brand AS app, CAST(500 * count(*) AS BIGINT) AS max_allowed FROM part GROUP BY p_brand)
    SELECT app, role AS asked, CAST(instances AS BIGINT) AS amount, max_allowed FROM req JOIN lim USING (app, role) WHERE max_allowed >= 0 AND instances > max_allowed
    UNION ALL SELECT app, 'memory', total, max_allowed FROM tot JOIN tl USING (app) WHERE total > max_allowed""",
    ("app_config_layer",),
)
def limit_violations(t: Tables):
    part = t.raw("part")
    app = F.col("p_brand").alias("app")
    per_role = part.groupBy(app, F.lower("p_type").alias("role")).agg(
        (F.max("p_partkey") % 5 - 1).alias("max_allowed")
    )
    per_app = part.groupBy(app).agg((F.count(F.lit(1)) * 500).alias("max_allowed"), F.lit("memory").alias("resource"))
    by_role = settings.limit_violations(requests(t), per_role, ["app", "role"], "instances")
    totals = settings.resource_totals(requests(t))
    by_total = settings.limit_violations(totals, per_app, ["app", "resource"], "total")
    return by_role.select(
        "app", F.col("role").alias("asked"), F.col("instances").cast("long").alias("amount"), "max_allowed"
    ).unionByName(by_total.select("app", F.col("resource").alias("asked"), F.col("total").alias("amount"), "max_allowed"))


def stages(t: Tables) -> DataFrame:
    """Role lists per application: some lack one list, some hold lists that do not add up."""
    return (
        settings.roles(merged(t))
        .groupBy("app")
        .agg(F.array_sort(F.collect_set("role")).alias("roles"))
        .withColumn("_n", F.regexp_extract("app", r"(\d+)", 1).cast("int"))
        .select(
            "app", "roles",
            F.when(F.col("_n") % 4 == 0, F.array().cast("array<string>"))
            .otherwise(F.slice("roles", 1, 2)).alias("prepare"),
            F.when(F.col("_n") % 4 == 1, F.array().cast("array<string>"))
            .when(F.col("_n") % 4 == 2, F.slice("roles", 4, 99))
            .otherwise(F.slice("roles", 3, 99)).alias("training"),
        )
    )


STAGE_SQL = f"""{MERGED_SQL},
    r AS (SELECT app, list_sort(list(DISTINCT regexp_extract(key, '^job\\.([a-z]+)\\.instances$', 1))) AS roles,
                 CAST(regexp_extract(app, '([0-9]+)', 1) AS INT) AS n FROM m WHERE key LIKE '%.instances' GROUP BY app),
    g AS (SELECT app, roles, CASE WHEN n % 4 = 0 THEN [] ELSE roles[1:2] END AS prepare,
                 CASE WHEN n % 4 = 1 THEN [] WHEN n % 4 = 2 THEN roles[4:] ELSE roles[3:] END AS training FROM r),
    st AS (SELECT app, roles, CASE WHEN len(prepare) = 0 AND len(training) > 0 THEN list_filter(roles, lambda x: NOT list_contains(training, x)) ELSE prepare END AS prepare,
                  CASE WHEN len(training) = 0 AND len(prepare) > 0 THEN list_filter(roles, lambda x: NOT list_contains(prepare, x)) ELSE training END AS training FROM g),
    sv AS (SELECT app, prepare, training, len(prepare) + len(training) = len(roles) OR len(prepare) + len(training) = 0 AS valid FROM st)"""


@query(
    "U02_complete_stages",
    f"{STAGE_SQL} SELECT app, array_to_string(prepare, ',') AS prepare, array_to_string(training, ',') AS training, valid FROM sv",
    ("app_config_layer",),
)
def complete_stages(t: Tables):
    return settings.complete_stages(stages(t)).select(
        "app", F.array_join("prepare", ",").alias("prepare"), F.array_join("training", ",").alias("training"), "valid"
    )


@query(
    "D01_stage_edges",
    f"""{STAGE_SQL}, e AS (SELECT app, unnest(training) AS role, prepare FROM sv WHERE valid),
    f AS (SELECT app, role, unnest(prepare) AS depends_on FROM e) SELECT * FROM f WHERE depends_on <> 'economy'""",
    ("app_config_layer",),
)
def stage_edges(t: Tables):
    return settings.stage_edges(stages(t), untracked=["economy"])


@query(
    "U05_role_lists",
    """SELECT app, key, array_to_string(list_distinct_ordered, ',') AS off,
          CASE WHEN value = '0' THEN 'ps' ELSE concat(value, ',ps') END AS grown FROM (
       SELECT *, CASE WHEN rest = 'tensorboard' OR rest = 'ps' THEN [rest] ELSE [rest, 'tensorboard'] END AS list_distinct_ordered
       FROM (SELECT app, key, value, split_part(key, '.', 2) AS rest FROM app_config_layer) a) b""",
    ("app_config_layer",),
)
def role_lists(t: Tables):
    role = F.split_part("key", F.lit("."), F.lit(2))
    off = sets.role_union(F.array(role), F.array(F.lit("tensorboard")), F.array(role))
    listed = F.when(F.col("value") == "0", "").otherwise(F.col("value"))
    return t.app_config_layer.select(
        "app", "key", F.array_join(off, ",").alias("off"), sets.add_role(listed, "ps").alias("grown")
    )
