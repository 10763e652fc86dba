"""Row predicates over tasks, keys and application lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.names import _col

# Roles left out of monitoring unless configured otherwise.
SIDECAR_ROLES = ("tensorboard",)
# Exit codes with a meaning of their own in the public cluster API.
SUCCESS = 0
KILLED_BY_MASTER = -105


def is_untracked(role: Column | str, untracked: list[str]) -> Column:
    return _col(role).isin(list(untracked)) if untracked else F.lit(False)


def is_monitored(
    role: Column | str, untracked: list[str] = (), sidecar: list[str] = SIDECAR_ROLES
) -> Column:
    off = [*untracked, *sidecar]
    return ~_col(role).isin(off) if off else F.lit(True)


def breaks_rule(key: Column | str, deny: list[str]) -> Column:
    """True if ``key`` holds a match of any denied pattern: one pass, no join."""
    key = _col(key)
    hit = F.lit(False)
    for pattern in deny:
        hit = hit | key.rlike(pattern)
    return hit


def is_completed(exit_code: Column | str = "exit_code") -> Column:
    return _col(exit_code).isNotNull()


def task_status(exit_code: Column | str, launched: Column | None = None) -> Column:
    """SUCCEEDED, FINISHED (killed by the master) or FAILED by exit code; RUNNING without one."""
    code = _col(exit_code)
    done = F.when(code == SUCCESS, "SUCCEEDED").when(code == KILLED_BY_MASTER, "FINISHED").otherwise("FAILED")
    idle = F.lit("RUNNING") if launched is None else F.when(launched, "RUNNING").otherwise("NEW")
    return F.when(code.isNull(), idle).otherwise(done)


def is_failed(exit_code: Column | str = "exit_code") -> Column:
    return F.coalesce(task_status(exit_code) == "FAILED", F.lit(False))


def contains_text(searches: dict[str, str]) -> Column:
    """Every searched column holds its text, ignoring case."""
    hit = F.lit(True)
    for column, text in searches.items():
        hit = hit & F.lower(F.col(column).cast("string")).contains(text.lower())
    return hit


ATTENTION = ["FAILED", "SUCCEEDED", "FINISHED", "RUNNING", "NEW", "READY"]


def attention_rank(status: Column | str) -> Column:
    """Position of a task status in the order it needs attention."""
    return F.array_position(F.array(*map(F.lit, ATTENTION)), _col(status)).cast("int")
