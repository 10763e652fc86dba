"""Rules of each application, read from its own settings (k, key, value).

Which roles are tracked or end the application, what roles wait for and how groups time out differ from
application to application; the results are tables with an application column that the task operators take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.config import Keys
from runledger.functions.predicates import SIDECAR_ROLES
from runledger.operators.skew import dim_join

# Fixed: the names of settings, below the prefix.
UNTRACKED = "application.untracked.jobtypes"
SIDECARS = "application.sidecar.jobtypes"
STOPPING = "application.stop-on-failure-jobtypes"
STRICT = "application.fail-on-worker-failure-enabled"
DEPENDS_ON = "depends-on"


def listed(text: Column) -> Column:
    """The names of a comma list; none of a missing or empty one."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def app_rules(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(k, off, stop, strict): roles that are not monitored, roles whose failure ends the application, any role's does."""
    asked = lambda name: F.max(F.when(F.col("key") == f"{keys.prefix}.{name}", F.col("value")))
    sidecars = F.coalesce(asked(SIDECARS), F.lit(",".join(SIDECAR_ROLES)))
    return settings.groupBy("k").agg(
        F.array_union(listed(asked(UNTRACKED)), listed(sidecars)).alias("off"), listed(asked(STOPPING)).alias("stop"),
        (F.lower(F.coalesce(asked(STRICT), F.lit("false"))) == "true").alias("strict"),
    )


def with_rules(tasks: DataFrame, settings: DataFrame, keys: Keys = Keys(), hot: list | None = None) -> DataFrame:
    """Tasks with ``tracked``, ``stops`` and ``strict`` by the rules of their application; without settings all
    but sidecars are tracked and none stops."""
    joined = dim_join(tasks, app_rules(settings, keys), "k", "left", hot)
    has = lambda c, default: F.coalesce(F.array_contains(c, F.col("role")), default)
    return joined.withColumns({
        "tracked": ~has("off", F.col("role").isin(list(SIDECAR_ROLES))), "stops": has("stop", F.lit(False)),
        "strict": F.coalesce("strict", F.lit(False)),
    }).drop("off", "stop")


def role_edges(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(k, role, depends_on) of the roles that wait for others."""
    part = settings.select("k", keys.role_setting("key").alias("s"), "value").where(F.col("s.setting") == DEPENDS_ON)
    return part.select("k", F.col("s.role").alias("role"), F.explode(listed(F.col("value"))).alias("depends_on")).distinct()


def group_members(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(k, grp, role) of the groups of roles."""
    named = settings.select("k", keys.group("key").alias("grp"), "value").where("grp is not null")
    return named.select("k", "grp", F.explode(listed(F.col("value"))).alias("role")).distinct()


def group_rules(settings: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """(k, role, grp, timeout_s, ignored): how long a role may run on after a group has ended, and what follows."""
    ignored = F.col("key").endswith(".ignored")
    base = F.regexp_replace("key", r"\.ignored\z", "")
    found = settings.select("k", keys.waiting_role(base).alias("role"), keys.awaited_group(base).alias("grp"), "value", ignored.alias("_i"))
    return found.where("role is not null").groupBy("k", "role", "grp").agg(
        F.max(F.when(~F.col("_i"), F.col("value"))).try_cast("int").alias("timeout_s"),
        F.coalesce(F.bool_or(F.col("_i") & (F.lower("value") == "true")), F.lit(False)).alias("ignored"),
    ).where("timeout_s is not null")
