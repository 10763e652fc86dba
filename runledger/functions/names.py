"""History file names, task ids, paths, dates and durations as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_PROGRESS = "inprogress"
HISTORY_FILE = "jhist"
APP_ID = r"application_\d+_\d+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(name: Column) -> Column:
    """Dash-separated parts before the first dot; empty parts at the end do not count."""
    return F.split(F.regexp_replace(F.substring_index(name, ".", 1), "-+$", ""), "-")


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})\\z")


def in_progress(name: Column | str) -> Column:
    """True if a history file has not reached its final name."""
    return ~_col(name).endswith(HISTORY_FILE)


def is_history_file(name: Column | str) -> Column:
    return _col(name).contains(HISTORY_FILE)


def parse_history_name(name: Column | str) -> Column:
    """struct(app_id, started_ms, completed_ms, usr, status) of a history file name."""
    name = _col(name)
    p = _parts(name)
    running = name.endswith(IN_PROGRESS)
    number = lambda i: _part(p, i).try_cast("long")
    return F.struct(
        _part(p, 0).alias("app_id"),
        number(1).alias("started_ms"),
        F.when(running, F.lit(-1).cast("long")).otherwise(number(2)).alias("completed_ms"),
        F.when(running, _part(p, 2)).otherwise(_part(p, 3)).alias("usr"),
        F.when(running, F.lit("RUNNING")).otherwise(_part(p, 4)).alias("status"),
    )


def is_valid_history_name(name: Column | str, id_pattern: str = APP_ID) -> Column:
    """True where :func:`history_name_fault` finds nothing, by one pattern per kind of name."""
    name = _col(name)
    usr = r"[^-.\p{Lu}\p{Lt}]*"
    running = rf"\d+-(?=[^.]*[^-.]){usr}(?:-[^.]*)?\..*{IN_PROGRESS}\z"
    ended = rf"\d+-\d+-{usr}-[^-.\p{{Ll}}]+-*\.(?!.*{IN_PROGRESS}\z)"
    return name.rlike(f"^(?:{id_pattern})-(?:{running}|{ended})")


def history_name_fault(name: Column | str, id_pattern: str = APP_ID) -> Column:
    """Why a history file name is invalid; null for a valid one."""
    name = _col(name)
    p = _parts(name)
    running = name.endswith(IN_PROGRESS)
    number = lambda i: full_match(_part(p, i), r"\d+")
    lower = lambda i: _part(p, i) == F.lower(_part(p, i))
    fault = (
        F.when(name.isNull() | (name == ""), "empty")
        .when(~name.contains("."), "no extension")
        .when(F.size(p) < 3, "missing fields")
        .when(~running & (F.size(p) != 5), "field count")
        .when(~full_match(_part(p, 0), id_pattern), "id")
        .when(~number(1), "started")
        .when(~running & ~number(2), "completed")
        .when(F.when(running, ~lower(2)).otherwise(~lower(3)), "user")
        .when(~running & (_part(p, 4) != F.upper(_part(p, 4))), "status")
    )
    # The one pattern spares valid names the whole chain.
    return F.when(~F.coalesce(is_valid_history_name(name, id_pattern), F.lit(False)), fault)


def build_history_name(
    app_id: Column | str, started_ms: Column | str, completed_ms: Column | str, usr: Column | str,
    status: Column | str,
) -> Column:
    """The inverse of :func:`parse_history_name`; a null or empty status means in progress."""
    status = F.nullif(_col(status), F.lit(""))
    completed = F.nullif(_col(completed_ms), F.lit(-1).cast("long"))
    base = F.concat_ws(
        "-", _col(app_id), _col(started_ms).cast("string"), completed.cast("string"), _col(usr), status
    )
    return F.concat(
        base,
        F.when(status.isNull(), F.lit(f".{HISTORY_FILE}.{IN_PROGRESS}")).otherwise(f".{HISTORY_FILE}"),
    )


def task_id(role: Column | str, idx: Column | str) -> Column:
    return F.concat_ws(":", _col(role), _col(idx).cast("string"))


def parse_task_id(text: Column | str) -> Column:
    """struct(role, idx) of ``role:index``; null where the text is not one."""
    p = F.split(_col(text), ":")
    idx = F.get(p, F.lit(1)).try_cast("int")
    return F.when(
        (F.size(p) == 2) & idx.isNotNull() & (F.get(p, F.lit(0)) != ""),
        F.struct(F.get(p, F.lit(0)).alias("role"), idx.alias("idx")),
    )


def last_component(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def is_job_folder(path: Column | str, pattern: str) -> Column:
    return full_match(last_component(path), pattern)


def zoned(ms: Column | str, zone: str) -> Column:
    """Wall-clock time (timestamp_ntz) of an epoch-ms value in ``zone``, whatever the session zone."""
    utc = F.timestamp_add("MILLISECOND", _col(ms), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def date_directory(ms: Column | str, zone: str = "UTC") -> Column:
    return F.date_format(zoned(ms, zone), "yyyy/MM/dd")


def display_time(ms: Column | str) -> Column:
    """Time shown on the application pages (UTC); ``-`` for a value that is not set."""
    ms = _col(ms)
    return F.when(ms == -1, "-").otherwise(
        F.concat(F.date_format(zoned(ms, "UTC"), "dd MMM yyyy HH:mm:ss:SSS"), F.lit(" +0000"))
    )


def duration_text(ms: Column | str) -> Column:
    """``1D 2H 3m 4s`` without its zero parts."""
    s = F.floor(_col(ms) / 1000)
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    return F.concat(
        part(F.floor(s / 86400), "D "),
        part(F.floor(s / 3600) % 24, "H "),
        part(F.floor(s / 60) % 60, "m "),
        part(s % 60, "s"),
    )
