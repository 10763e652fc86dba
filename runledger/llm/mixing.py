"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

The words of all sources are shared out by weight; a source whose share is above ``max_epochs`` times its size
is clamped there and the excess goes to the others by weight, until no share is above its cap. A source
then gives whole repetitions of all its texts and, for the rest, the first words of its texts in a seeded order.
The order is that of a hash of identifier and text; a source is split by the leading digits of the hash into slices, so the
running sums of a source of any size are sums inside slices plus the sizes of the slices before. There are 4,096 slices,
and 16 times as many whenever a slice of the whole table would pass ``SLICE_ROWS`` rows; the order is the same at any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import text_of, word_count
from runledger.session import written

SLICE_ROWS = 2**18


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` written with ``name``, its place from 0 in a global order, counted range by range."""
    chunks = written(df.repartitionByRange(order).withColumn("_chunk", F.spark_partition_id()), "op8-ranked")
    inside = chunks.withColumn("_rank", F.row_number().over(Window.partitionBy("_chunk").orderBy(order)) - 1)
    before = (
        chunks.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).drop("_n")
    )
    return inside.join(F.broadcast(before), "_chunk").withColumn(name, F.col("_before") + F.col("_rank")).drop("_chunk", "_rank", "_before")


def water_filled(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``; one aggregate over them a round."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cap = wide("source_size") * max_epochs
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    held, weight = 0, int(sources.agg(F.sum("weight")).first()[0] or 0)
    while True:
        clamped = cap * weight <= wide("weight") * (total - held)
        row = sources.agg(F.sum(F.when(clamped, cap)).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight")).first()
        if (int(row["held"] or 0), int(row["weight"] or 0)) == (held, weight):
            break
        held, weight = int(row["held"] or 0), int(row["weight"] or 0)
        if not weight:
            break
    share = F.col("weight") * F.lit(float(total - held)) / F.lit(float(max(weight, 1)))
    clamped = (cap * weight <= wide("weight") * (total - held)) | F.lit(not weight)
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mixed(df: DataFrame, keep: list[str], weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``df`` with columns ``keep``, size, source_size, target (of the source), taken and before.

    size: words of the text (null: none). Sources are weighted in code point order, null last, ``weights``
    repeating. taken: words that the mix takes from the row, repeats counted; a source's sum is its target
    rounded down. before: words of the source that lie ahead of the row in the seeded order. Rows with equal or
    missing identifiers are told apart by their texts; rows equal in both are interchangeable and share a slice. Texts without words, and
    sources without them, give nothing. Empty tables give no rows. Columns of ``df`` not in ``keep`` are not
    returned, and those in ``keep`` may not have the names above.
    """
    digits = 3
    rows_a_slice = df.count() / 16**digits
    while rows_a_slice > SLICE_ROWS:
        digits, rows_a_slice = digits + 1, rows_a_slice / 16
    rows = df.select(
        F.struct(*keep).alias("_row"), F.col("source").alias("_source"), word_count().alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_of())).alias("_hash"),
    ).withColumn("_slice", F.substring("_hash", 1, digits))
    slices = written(rows.groupBy("_source", "_slice").agg(F.sum("size").alias("_size")), "op8-slices")
    sources = slices.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    sources = ranked(sources, F.col("_source").asc_nulls_last(), "_place").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    )
    sources = water_filled(sources, max_epochs).select(F.col("_source").alias("_s"), "source_size", "target")
    ahead = F.sum("_size").over(Window.partitionBy("_source").orderBy("_slice")) - F.col("_size")
    slices = slices.withColumn("_ahead", ahead).join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_size")
    slices = slices.withColumnsRenamed({"_source": "_s", "_slice": "_l"})
    inside = Window.partitionBy("_source", "_slice").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("_rest") - F.col("before")))
    return (
        rows.withColumn("_sum", F.sum("size").over(inside) - F.col("size"))
        .join(slices, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_l")))
        .withColumn("before", F.col("_ahead") + F.col("_sum"))
        .withColumn("_words", F.floor("target"))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("_words") - F.col("_whole") * F.col("source_size"))
        .select("_row.*", "size", "source_size", "target", taken.cast("long").alias("taken"), "before", "_whole", "_rest")
    )


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, copies as rows of their own.

    Documents are not cut: the one in which the share of its source ends is taken once more if more than half
    of its words lie inside the share. Texts without words have nothing to repeat and stay once.
    """
    extra = F.greatest(F.lit(0), F.least("size", F.col("_rest") - F.col("before"))) * 2 > F.col("size")
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("_whole") + extra.cast("int")).cast("int")
    found = mixed(df.select(F.struct(*df.columns).alias("_doc"), "doc_id", "source", "text"), ["_doc"], **how)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where("_copy > 0").select("_doc.*")


#: The mix of ``documents`` in SQL, with the parameters of the query.
MIX_SQL = r"""
with rows as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5('mix' || coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')) as h
    from documents
), sizes as (
    select source, sum(size)::bigint as source_size,
        1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
    from rows group by source
), ordered as (
    select *, 3 * source_size as cap, sum(source_size) over () as total, sum(weight) over () as weights,
        coalesce(sum(3 * source_size) over before, 0) as held, coalesce(sum(weight) over before, 0) as held_weight
    from sizes
    window before as (order by 3.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), clamped as (
    select *, cap * (weights - held_weight) <= weight * (total - held) as is_clamped from ordered
), level as (
    select coalesce(sum(cap) filter (is_clamped), 0) as held, coalesce(sum(weight) filter (not is_clamped), 0) as weight from clamped
), targets as (
    select c.source, c.source_size,
        case when is_clamped then cap::double else (c.weight * (c.total - l.held))::double / l.weight::double end as target
    from clamped c, level l
), placed as (
    select r.*, t.source_size, t.target, floor(t.target)::bigint as words,
        sum(size) over (partition by r.source order by h rows between unbounded preceding and current row) - size as before
    from rows r join targets t on r.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target,
    (case when source_size > 0 then words // source_size * size + greatest(0, least(size, words % source_size - before)) else 0 end)::bigint as taken
from placed
"""
