"""Role dependency graphs as tables edges(app, role, depends_on)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import written

FROM, TO = ["app", "role"], ["app", "depends_on"]


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges but those into a role that waits for nothing and those out of a role that nothing waits for."""
    waiting = edges.select("app", F.col("role").alias("depends_on")).distinct()
    awaited = edges.select("app", F.col("depends_on").alias("role")).distinct()
    return written(edges.join(waiting, TO, "left_semi").join(awaited, FROM, "left_semi"), "edges")


def contracted(edges: DataFrame) -> DataFrame:
    """The same graph with every chain of roles that have one edge in and one out as a single edge.

    Each inner role points to its successor, and pointers double (a role takes the pointer of the role it points to)
    until they leave the chain: as many rounds as the logarithm of the longest. A pointer that never leaves runs in a circle.
    """
    out = edges.groupBy("app", "role").agg(F.count(F.lit(1)).alias("_out"), F.min("depends_on").alias("to"))
    into = edges.groupBy("app", F.col("depends_on").alias("role")).agg(F.count(F.lit(1)).alias("_in"))
    inner = out.join(into, FROM).where("_out = 1 AND _in = 1 AND role <> to").select("app", "role", "to")
    inner = written(inner.withColumn("open", F.lit(True)), "pointers")
    longest = inner.groupBy("app").count().agg(F.max("count")).first()[0]
    if longest is None:
        return edges
    pointers = inner
    for _ in range(math.ceil(math.log2(longest)) + 1):
        ahead = pointers.select("app", F.col("role").alias("to"), F.col("to").alias("_to"), F.lit(True).alias("_hit"))
        pointers = written(
            pointers.join(ahead, ["app", "to"], "left")
            .select("app", "role", F.coalesce("_to", "to").alias("to"), F.col("_hit").isNotNull().alias("open")),
            "pointers",
        )
        if pointers.where("open").isEmpty():
            break
    circles = pointers.where("open").select("app", "role", F.col("role").alias("depends_on"))
    ends = pointers.where("NOT open").select("app", F.col("role").alias("depends_on"), "to")
    outer = edges.join(inner.select(*FROM), FROM, "left_anti").join(ends, TO, "left")
    kept = outer.select("app", "role", F.coalesce("to", "depends_on").alias("depends_on"))
    return written(kept.unionByName(circles).distinct(), "edges")


def acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per application: is its graph free of cycles. Edges to absent roles do not count.

    Graphs are trimmed from both ends, for all applications at once. When nothing can be trimmed, every role left waits
    for one and is waited for, so each graph left holds a cycle. After two rounds chains are contracted too, so that
    one of any length goes in a logarithm of its length. Each round is written out, so plans stay short.
    """
    present = nodes.select("app", F.col("role").alias("depends_on"))
    left = written(edges.join(present, TO, "left_semi").distinct(), "edges")
    count, rounds = left.count(), 0
    while count:
        before, rounds = count, rounds + 1
        left = trimmed(left)
        count = left.count()
        if count == before:
            break
        if count and rounds > 2:
            left = contracted(left)
            count = left.count()
    cyclic = left.select("app").distinct().withColumn("_cyclic", F.lit(True))
    return (
        nodes.select("app").distinct().join(cyclic, "app", "left")
        .select("app", F.col("_cyclic").isNull().alias("acyclic"))
    )
