"""Per-task environments derived from a cluster spec (JSON: role -> list of host:port)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.config import split_host_port
from runledger.functions.names import _col

SPEC = "map<string,array<string>>"
SIDECAR_ROLE = "tensorboard"
EVALUATOR_ROLE = "evaluator"


def cluster_spec(text: Column | str) -> Column:
    return F.from_json(_col(text), SPEC)


def tf_cluster(spec: Column, role: Column | str) -> Column:
    """The spec as one role sees it: no sidecar, evaluators for evaluators only."""
    is_evaluator = F.lower(_col(role)) == EVALUATOR_ROLE
    return F.map_filter(
        spec,
        lambda name, _: (name != SIDECAR_ROLE) & (is_evaluator | (F.lower(name) != EVALUATOR_ROLE)),
    )


def tf_config(spec: Column, role: Column | str, idx: Column | str) -> Column:
    return F.to_json(
        F.struct(
            tf_cluster(spec, role).alias("cluster"),
            F.struct(_col(role).alias("type"), _col(idx).alias("index")).alias("task"),
        )
    )


def rank_env(spec: Column, idx: Column | str, tasks: Column | str) -> Column:
    """struct(init_method, rank, world); null without a first worker."""
    first = F.get(F.try_element_at(spec, F.lit("worker")), F.lit(0))
    return F.when(
        first.isNotNull(),
        F.struct(
            F.concat(F.lit("tcp://"), first).alias("init_method"),
            _col(idx).cast("string").alias("rank"),
            _col(tasks).cast("string").alias("world"),
        ),
    )


def parameter_server_env(spec: Column, role: Column | str) -> Column:
    """struct(role, root_uri, root_port, servers, workers); null without a usable scheduler."""
    root = split_host_port(F.get(F.try_element_at(spec, F.lit("scheduler")), F.lit(0)))
    count = lambda name: F.when(
        F.map_contains_key(spec, F.lit(name)), F.size(F.try_element_at(spec, F.lit(name)))
    ).otherwise(0)
    return F.when(
        root.isNotNull(),
        F.struct(
            _col(role).alias("role"),
            root["host"].alias("root_uri"),
            root["port"].alias("root_port"),
            count("server").alias("servers"),
            count("worker").alias("workers"),
        ),
    )
