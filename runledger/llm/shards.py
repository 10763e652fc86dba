"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group. A group whose share of the bytes, tokens or rows is above 1 / ``bundles``
is an item of its own (there are at most 3 * ``bundles`` of them); all others are hashed into ``bundles``
bundles, an item each. A group with more than a quarter of a shard is split by a hash into parts of about 1/16 of
a shard, so the number of items is bounded by the parameters and not by the data. The hash is that of the identifier
and of the row's number among rows of that group and identifier, so missing and repeated identifiers split too.
Items are placed in descending order of their largest share, each into the shard where the dot product of
its vector with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import numbered, text_of, word_count
from runledger.session import written


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (row of ``vectors``), given in the order in which they are placed."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.empty(len(share), np.int32)
    for i, item in enumerate(share):
        out[i] = best = int(np.argmax(residual @ item))
        residual[best] -= item
    return out


def vector_shards(df: DataFrame, shards: int = 16, bundles: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: identifier, size, text_crc32, n_tokens, shard, slot.

    size is the UTF-8 length of the text plus 1, n_tokens its number of words. slot numbers the rows of a
    shard from 0 without gaps. Null texts count as empty and form one group with the empty ones; rows with a
    null identifier and repeated rows are placed like any other. An empty table gives no rows. Columns of
    ``df`` other than the two named are not returned.
    """
    text = text_of(text_col)
    rows = written(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), word_count(text_col).alias("n_tokens"),
            F.xxhash64(text).alias("_key"), F.monotonically_increasing_id().alias("_row"),
        ),
        "op1-rows",
    )
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    total = rows.agg(*sums).first()
    part = max(1, total["b"] or 0), max(1, total["t"] or 0), max(1, total["r"])
    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip("btr", part)))
    heavy = (
        rows.groupBy("_key").agg(*sums).where(share > 1.0 / bundles)
        .select("_key", F.when(share * shards > 0.25, F.ceil(share * shards * 16)).otherwise(1).cast("int").alias("_parts"))
    )
    heavy = F.broadcast(written(heavy, "op1-heavy"))
    names = ["doc_id", "size", "text_crc32", "n_tokens"]
    joined = rows.join(heavy, "_key", "left")
    whole = F.when(F.col("_parts").isNull(), F.pmod("_key", F.lit(bundles))).otherwise(F.col("_key"))
    small = joined.where("_parts is null or _parts = 1").select(
        *names, whole.alias("_item"), F.when(F.col("_parts").isNull(), -1).otherwise(0).alias("_part"), F.lit(0).cast("long").alias("_copy"))
    split = joined.where("_parts > 1").withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    split = numbered(split, ["_key", "_null", "_id"], ["_row"], "_copy").select(
        *names, F.col("_key").alias("_item"), F.pmod(F.xxhash64("doc_id", "_copy"), F.col("_parts")).cast("int").alias("_part"), "_copy")
    keyed = written(small.unionByName(split), "op1-keyed")
    items = keyed.groupBy("_item", "_part").agg(*sums).collect()
    vectors = np.array([(x["b"], x["t"], x["r"]) for x in items], np.float64).reshape(-1, 3)
    largest = (vectors / part).max(axis=1, initial=0)
    order = sorted(range(len(items)), key=lambda i: (-largest[i], items[i]["_item"], items[i]["_part"]))
    placed = [(items[i]["_item"], items[i]["_part"], int(s)) for i, s in zip(order, place(vectors[order], shards))]
    placed = df.sparkSession.createDataFrame(placed, "_item long, _part int, shard int")
    sharded = keyed.join(F.broadcast(placed), ["_item", "_part"]).drop("_item", "_part")
    return numbered(sharded, ["shard"], ["doc_id", "text_crc32", "_copy"], "slot", buckets=4096).drop("_copy")
