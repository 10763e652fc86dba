"""Configuration tables: layers, container requests, limits, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.config import Keys, memory_mb
from runledger.operators.rules import UNTRACKED, listed
from runledger.operators.series import Series

# Configuration layers, lowest precedence first within the files.
DEFAULTS, FILE, COMMAND_LINE, SITE = 0, 1, 2, 3


def merge_layers(layers: DataFrame, multi_value: Column) -> DataFrame:
    """One row per (app, key) from (app, layer, pos, key, value).

    Within a layer the last entry wins. The command line beats every file, the site file beats
    the application's file, and that beats the defaults. For ``multi_value`` keys the command
    line value is appended to what defaults and file gave, as a comma list.
    """
    held = layers.groupBy("app", "key").agg(
        *(
            F.max_by(F.when(F.col("layer") == n, F.col("value")), F.when(F.col("layer") == n, F.col("pos"))).alias(f"_{n}")
            for n in (DEFAULTS, FILE, COMMAND_LINE, SITE)
        )
    )
    command = F.col(f"_{COMMAND_LINE}")
    base = F.coalesce(f"_{FILE}", f"_{DEFAULTS}")
    return held.select(
        "app",
        "key",
        F.when(command.isNotNull() & multi_value, F.concat_ws(",", base, command))
        .otherwise(F.coalesce(command, F.col(f"_{SITE}"), base))
        .alias("value"),
    )


def roles(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Distinct (app, role) named by an instances key."""
    return settings.select("app", keys.role("key").alias("role")).where("role is not null").distinct()


def container_requests(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """What each role asks for, defaults filled in; roles without instances are left out."""
    part = settings.select("app", keys.role_setting("key").alias("s"), "value").where("s is not null")
    asked = lambda name: F.max(F.when(F.col("s.setting") == name, F.col("value")))
    number = lambda name, default: F.coalesce(asked(name).try_cast("int"), F.lit(default))
    return (
        part.groupBy("app", F.col("s.role").alias("role"))
        .agg(
            number("instances", 0).alias("instances"),
            memory_mb(F.coalesce(asked("memory"), F.lit("2g"))).alias("memory_mb"),
            number("vcores", 1).alias("vcores"),
            number("gpus", 0).alias("gpus"),
            asked("node-label").alias("node_label"),
            asked("placement-spec").alias("placement_spec"),
            asked("allocation-tags").alias("allocation_tags"),
        )
        .where("instances > 0")
    )


# Fixed: names of settings of a whole application, below the prefix.
ALL_PLACEMENT, ALL_TAGS = "containers.placement-spec", "containers.allocation-tags"
PREPARE, TRAINING = "application.prepare-stage", "application.training-stage"


def full_requests(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Container requests with their priority and what else they carry.

    Placement and tags of a role fall back on those of all containers; tags are split at commas. ``depends_on``: for roles of
    the training stage the roles of the prepare stage that are monitored, of which a missing stage is all other roles;
    null where the stages do not add up. A role's priority is its place by name, so that no two are equal.
    """
    asked = lambda name: F.max(F.when(F.col("key") == f"{keys.prefix}.{name}", F.col("value")))
    whole = settings.groupBy("app").agg(
        asked(ALL_PLACEMENT).alias("_place"), asked(ALL_TAGS).alias("_tags"), listed(asked(PREPARE)).alias("prepare"),
        listed(asked(TRAINING)).alias("training"), listed(asked(UNTRACKED)).alias("_off"),
        F.array_sort(F.array_compact(F.collect_set(keys.role("key")))).alias("roles"),
    )
    staged = complete_stages(whole).join(whole.select("app", "_place", "_tags", "_off"), "app")
    both = priorities(container_requests(settings, keys), hot=False).join(staged, "app")
    waits = F.when(F.array_contains("training", F.col("role")), F.array_except("prepare", "_off")).otherwise(F.array().cast("array<string>"))
    return both.select(
        "app", "role", "instances", "memory_mb", "vcores", "gpus", "priority", "node_label",
        F.when(F.col("valid"), waits).alias("depends_on"), F.coalesce("placement_spec", "_place").alias("placement_spec"),
        F.split(F.coalesce("allocation_tags", "_tags"), ",").alias("allocation_tags"),
    )


def priorities(requests: DataFrame, hot: bool | None = None) -> DataFrame:
    """Distinct priority number per role of an application, from 0."""
    out = Series(requests, ["app"], ["role"], hot).row_number("_n").df
    return out.withColumn("priority", (F.col("_n") - 1).cast("int")).drop("_n")


def resource_totals(requests: DataFrame) -> DataFrame:
    """Amount times instances per (app, resource), over all roles."""
    n = F.col("instances").cast("long")
    item = lambda name, amount: F.struct(F.lit(name).alias("resource"), (amount * n).alias("amount"))
    return (
        requests.select(
            "app",
            F.inline(
                F.array(
                    item("memory", F.col("memory_mb")),
                    item("vcores", F.col("vcores")),
                    item("gpus", F.col("gpus")),
                    item("instances", F.lit(1)),
                )
            ),
        )
        .groupBy("app", "resource")
        .agg(F.sum("amount").alias("total"))
    )


def limit_violations(requested: DataFrame, limits: DataFrame, on: list[str], amount: str) -> DataFrame:
    """Rows asking for more than their limit; a negative or missing limit is none."""
    return requested.join(limits, on, "left").where(
        (F.col("max_allowed") >= 0) & (F.col(amount) > F.col("max_allowed"))
    )


def complete_stages(stages: DataFrame) -> DataFrame:
    """Fill the missing one of two stage lists with all other roles and check that they add up.

    ``stages``: app, roles, prepare, training (arrays of role names; the lists may be empty).
    """
    p, t, every = F.col("prepare"), F.col("training"), F.col("roles")
    none = lambda a: F.size(a) == 0
    neither = none(p) & none(t)
    prepare = F.when(none(p) & ~none(t), F.array_except(every, t)).otherwise(p)
    training = F.when(none(t) & ~none(p), F.array_except(every, p)).otherwise(t)
    return stages.select(
        "app",
        F.array_sort(prepare).alias("prepare"),
        F.array_sort(training).alias("training"),
        (neither | (F.size(prepare) + F.size(training) == F.size(every))).alias("valid"),
    )


def stage_edges(stages: DataFrame, untracked: list[str] = ()) -> DataFrame:
    """(app, role, depends_on): every training role waits for every tracked prepare role."""
    off = F.array(*map(F.lit, untracked)).cast("array<string>")
    return (
        complete_stages(stages)
        .where("valid")
        .select("app", F.explode("training").alias("role"), F.array_except("prepare", off).alias("_p"))
        .select("app", "role", F.explode("_p").alias("depends_on"))
    )


def dependency_instances(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Edges with the number of instances that must finish."""
    asked = requests.select("app", F.col("role").alias("depends_on"), F.col("instances").alias("waits_for"))
    return edges.join(asked, ["app", "depends_on"])
