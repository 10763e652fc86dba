"""Upkeep of the date-partitioned history store: move, finalise, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import in_progress, parse_history_name, zoned
from runledger.operators.skew import dim_join


def store_partition(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """Finished history files with the year, month and day they belong under, by completion."""
    done = zoned(parse_history_name("name")["completed_ms"], zone).cast("date")
    placed = files.where(~in_progress("name")).withColumn("_done", done)
    part = lambda pattern: F.date_format("_done", pattern)
    return placed.withColumns({"year": part("yyyy"), "month": part("MM"), "day": part("dd")}).drop("_done")


def expired_partitions(partitions: DataFrame, cutoff: Column) -> DataFrame:
    """Partitions (year, month, day as text) to drop, each with the coarsest level that goes whole.

    A year, month or day goes if its last day lies before the cutoff; other names are ignored.
    """
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    year = F.when(y.rlike(r"^\d{4}$"), y.cast("int"))
    month = F.when(m.rlike(r"^\d{2}$"), m.cast("int"))
    day = F.when(d.rlike(r"^\d{2}$"), d.cast("int"))
    level = (
        F.when(F.make_date(year, F.lit(12), F.lit(31)) < cutoff, "year")
        .when(F.last_day(F.make_date(year, month, F.lit(1))) < cutoff, "month")
        .when(F.make_date(year, month, day) < cutoff, "day")
    )
    return partitions.withColumn("level", level).where(F.col("level").isNotNull())


def expired_landing(dirs: DataFrame, modified_ms: str, cutoff: Column, zone: str = "UTC") -> DataFrame:
    """Landing directories last touched before the cutoff, in progress or not."""
    return dirs.where(zoned(modified_ms, zone).cast("date") < cutoff)


def finalise_killed(apps: DataFrame, killed: DataFrame, now_ms: int | Column) -> DataFrame:
    """Applications still in progress that were killed end now, as KILLED."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    hit = killed.select("app_id").distinct().withColumn("_killed", F.lit(True))
    ends = F.coalesce(F.col("_killed"), F.lit(False)) & (F.col("completed_ms") == -1)
    return (
        apps.join(hit, "app_id", "left")
        .withColumn("status", F.when(ends, "KILLED").otherwise(F.col("status")))
        .withColumn("completed_ms", F.when(ends, now.cast("long")).otherwise(F.col("completed_ms")))
        .drop("_killed")
    )


#: Gram length and stride by least id length. A stride of n needs ids of n - 1 letters more than a gram.
GRAMS = [(8, 5, 4), (3, 3, 1), (2, 2, 1), (1, 1, 1)]


def _holding(names: DataFrame, ids: DataFrame, gram: int, stride: int) -> DataFrame:
    """Names (app_id) that hold one of ``ids`` (_id), all of ``gram + stride - 1`` letters at least.

    Names are cut at every ``stride``-th place only. Wherever an id stands in a name, such a place lies in it, at one
    of its offsets that leave the same remainder; for each remainder the id is listed under its rarest gram there.
    A name that holds the gram at such a place is compared at the one position where the id would stand.
    """
    offsets = F.sequence(F.lit(0), F.length("_id") - gram)
    cut = ids.select("_id", F.explode(offsets).alias("_o")).withColumn("_g", F.substring("_id", F.col("_o") + 1, F.lit(gram)))
    frequency = cut.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    rarest = F.min(F.struct("_f", "_o", "_g")).alias("_r")
    index = dim_join(cut, frequency, "_g").groupBy("_id", F.pmod("_o", F.lit(stride)).alias("_m")).agg(rarest).select("_id", "_r._o", "_r._g")
    long = names.where(F.length("app_id") >= gram)
    places = F.sequence(F.lit(0), F.length("app_id") - gram, F.lit(stride))
    held = long.select("app_id", F.explode(places).alias("_p")).withColumn("_g", F.substring("app_id", F.col("_p") + 1, F.lit(gram)))
    start = F.col("_p") - F.col("_o")
    found = held.join(index, "_g").where((start >= 0) & (F.substring("app_id", start + 1, F.length("_id")) == F.col("_id")))
    return found.select("app_id")


def killed_landing(dirs: DataFrame, killed: DataFrame, mode: str = "equals") -> DataFrame:
    """Landing directories of killed applications.

    ``contains`` also takes directories whose name holds a killed id anywhere (an empty id is held by all); ids are looked
    up by grams, and no directory is compared with every id.
    """
    ids = killed.select(F.col("app_id").alias("_id")).where("_id is not null").distinct()
    if mode == "equals":
        return dirs.join(ids, F.col("app_id") == F.col("_id"), "left_semi")
    names = dirs.select("app_id").where("app_id is not null").distinct()
    sizes = ids.agg(F.min(F.length("_id")).alias("low"), F.max(F.length("_id")).alias("high")).first()
    if sizes["low"] is None:
        return dirs.limit(0)
    if sizes["low"] == 0:
        return dirs.where("app_id is not null")
    hits, above = None, sizes["high"] + 1
    for least, gram, stride in GRAMS:
        if sizes["low"] < above and sizes["high"] >= least:
            part = _holding(names, ids.where((F.length("_id") >= least) & (F.length("_id") < above)), gram, stride)
            hits = part if hits is None else hits.unionByName(part)
        above = min(above, least)
    return dirs.join(hits.distinct(), "app_id", "left_semi")
