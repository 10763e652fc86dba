"""Configuration values and keys: units, key=value lists, host:port, resources, key fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.names import _col, last_component

ARCHIVE_MARK = "#archive"


def memory_mb(text: Column | str) -> Column:
    """Megabytes of ``2g``, ``2048m`` or a plain number; null where it is no number."""
    t = F.lower(_col(text))
    before = lambda mark: F.substring_index(t, mark, 1).try_cast("long")
    return (
        F.when(t.contains("m"), before("m"))
        .when(t.contains("g"), before("g") * 1024)
        .otherwise(t.try_cast("long"))
    )


def parse_key_values(items: Column | str) -> Column:
    """Map of ``key=value`` strings; no ``=`` gives an empty value, the last of equal keys wins."""
    empty = F.create_map().cast("map<string,string>")

    def add(acc: Column, item: Column) -> Column:
        t = F.trim(item)
        at = F.instr(t, F.lit("="))
        key = F.when(at == 0, t).otherwise(F.substring(t, F.lit(1), at - 1))
        value = F.when(at == 0, F.lit("")).otherwise(F.substring(t, at + 1, F.length(t)))
        return F.map_concat(F.map_filter(acc, lambda k, _: k != key), F.create_map(key, value))

    return F.coalesce(F.aggregate(_col(items), empty, add), empty)


def split_host_port(text: Column | str) -> Column:
    """struct(host, port) of ``host:port``; null where the whole text is not one."""
    text = _col(text)
    pattern = r"^([\w.\-]+):(\d+)\z"
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.regexp_extract(text, pattern, 1).alias("host"),
            F.regexp_extract(text, pattern, 2).alias("port"),
        ),
    )


def host_port(host: Column | str, port: Column | str) -> Column:
    """``host:port``; a negative port shows as 0. Null while the host is unknown."""
    return F.concat(_col(host), F.lit(":"), F.greatest(_col(port), F.lit(0)).cast("string"))


def leading_float(text: Column | str) -> Column:
    """``10.3 %`` as a float; -1 where missing."""
    t = _col(text)
    return F.when(t.isNull(), F.lit(-1.0).cast("float")).otherwise(
        F.substring_index(F.trim(t), " ", 1).try_cast("float")
    )


def leading_long(text: Column | str) -> Column:
    """``725 MiB`` as a long; -1 where missing."""
    t = _col(text)
    return F.when(t.isNull(), F.lit(-1).cast("long")).otherwise(
        F.substring_index(F.trim(t), " ", 1).try_cast("long")
    )


def percent_used(used: Column | str, free: Column | str) -> Column:
    used, free = _col(used), _col(free)
    return F.try_divide(used.cast("double"), (used + free).cast("double")) * 100


def parse_resource(text: Column | str) -> Column:
    """struct(source, local_name, type) of ``source[::name][#archive]``; null if malformed."""
    t = _col(text)
    archive = F.lower(t).endswith(ARCHIVE_MARK)
    body = F.when(archive, F.substring(t, F.lit(1), F.length(t) - len(ARCHIVE_MARK))).otherwise(t)
    parts = F.split(body, "::")
    return F.when(
        F.size(parts) <= 2,
        F.struct(
            F.get(parts, F.lit(0)).alias("source"),
            F.coalesce(F.get(parts, F.lit(1)), last_component(F.get(parts, F.lit(0)))).alias("local_name"),
            F.when(archive, F.lit("ARCHIVE")).otherwise("FILE").alias("type"),
        ),
    )


def join_options(own: Column | str, default: Column | str) -> Column:
    """Option strings joined by a blank, which a missing one leaves out."""
    return F.concat_ws(" ", F.nullif(_col(own), F.lit("")), _col(default))


@dataclass(frozen=True)
class Keys:
    """Fields held in configuration keys below ``prefix``; each is null without a full match."""

    prefix: str = "job"

    def _field(self, key: Column | str, pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract(_col(key), f"^{self.prefix}\\.{pattern}\\z", group)
        return F.nullif(found, F.lit(""))

    def role(self, key: Column | str) -> Column:
        return self._field(key, r"([a-z]+)\.instances")

    def capped_resource(self, key: Column | str) -> Column:
        return self._field(key, r"task\.max-total-([a-z]+)")

    def group(self, key: Column | str) -> Column:
        return self._field(key, r"application\.group\.([A-Za-z]+)")

    def waiting_role(self, key: Column | str) -> Column:
        return self._field(key, r"application\.dependency\.([A-Za-z]+)\.timeout\.after\.([A-Za-z]+)")

    def awaited_group(self, key: Column | str) -> Column:
        return self._field(key, r"application\.dependency\.([A-Za-z]+)\.timeout\.after\.([A-Za-z]+)", 2)

    def role_setting(self, key: Column | str) -> Column:
        """struct(role, setting) of ``<prefix>.<role>.<setting>``."""
        key = _col(key)
        pattern = f"^{self.prefix}\\.([a-z]+)\\.([a-z-]+)\\z"
        return F.when(
            key.rlike(pattern),
            F.struct(
                F.regexp_extract(key, pattern, 1).alias("role"),
                F.regexp_extract(key, pattern, 2).alias("setting"),
            ),
        )


def reprefixed(key: Column | str, old: str, new: str) -> Column:
    """``key`` moved from prefix ``old`` to ``new``; null where it lacks ``old``."""
    key = _col(key)
    return F.when(key.startswith(old), F.concat(F.lit(new), F.substring(key, len(old) + 1, 1 << 30)))
