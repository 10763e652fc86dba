"""Queries over data-parallel fitting, meters and partition programs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import fit, program
from runledger.plans.registry import query
from runledger.plans.tables import Tables

SPLIT_SQL = "(l_orderkey % 100) >= 25"
FIT_SQL = f"f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE {SPLIT_SQL})"


def _train(t: Tables) -> DataFrame:
    return t.raw("lineitem").where(fit.is_training("l_orderkey"))


@query("M01_train_test_split", f"SELECT {SPLIT_SQL} AS training, count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM lineitem GROUP BY 1")
def train_test_split(t: Tables):
    return t.raw("lineitem").groupBy(fit.is_training("l_orderkey").alias("training")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("keys")
    )


@query("M02_linear_fit", f"{FIT_SQL} SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM f")
def linear_fit(t: Tables):
    out = fit.linear_fit(_train(t), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "M03_absolute_error",
    f"{FIT_SQL} SELECT round(avg(abs(l_extendedprice - (a * l_quantity + b))), 4) AS mae FROM lineitem, f WHERE NOT ({SPLIT_SQL})",
)
def absolute_error(t: Tables):
    held_out = t.raw("lineitem").where(~fit.is_training("l_orderkey"))
    fitted = fit.linear_fit(_train(t), "l_quantity", "l_extendedprice")
    return fit.absolute_error(held_out, fitted, "l_quantity", "l_extendedprice").select(F.round("mae", 4).alias("mae"))


# Fixed: mean and deviation of the image data set of the example programs.
MEAN, STD = 0.13066047740239478, 0.3081078087569972


@query(
    "M04_feature_scaling",
    f"""SELECT vec_id, unnest(generate_series(0, 63))::INT AS pos,
         round((unnest(embedding)::DOUBLE - {MEAN}) / {STD}, 6) AS normal, round(unnest(embedding)::DOUBLE / 255, 8) AS unit FROM embeddings""",
)
def feature_scaling(t: Tables):
    pair = F.arrays_zip(fit.scaled("embedding", MEAN, STD).alias("normal"), fit.scaled("embedding", 0.0, 255.0).alias("unit"))
    return t.raw("embeddings").select("vec_id", F.posexplode(pair).alias("pos", "v")).select(
        "vec_id", "pos", F.round("v.normal", 6).alias("normal"), F.round("v.unit", 8).alias("unit")
    )


@query("M05_softmax_classifier")
def softmax_classifier(t: Tables):
    rows = t.raw("embeddings")
    training = fit.is_training("vec_id")
    model = fit.softmax_fit(rows.where(training), "embedding", "label")
    return (
        fit.softmax_score(model, rows, "embedding")
        .groupBy(training.alias("training"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("int")).alias("accuracy"))
    )


@query("M05_gang_descent")
def gang_descent(t: Tables):
    """The same classifier trained by a gang over mini-batches, and its accuracy on both sides of the split."""
    rows, training = t.raw("embeddings"), fit.is_training("vec_id")
    members = min(4, t.spark.sparkContext.defaultParallelism)
    weights = fit.descent_fit(rows.where(training), "embedding", "label", "vec_id", 10, members, batch=64, epochs=2, rate=2.0)
    hit = (F.col("predicted") == F.col("label")).cast("int")
    return fit.linear_predicted(rows, "embedding", weights).groupBy(training.alias("training")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")
    )


@query(
    "M06_mean_gradient",
    """
    g AS (SELECT l_orderkey % 7 AS shard, avg(2 * (900.0::DOUBLE * l_quantity + 5 - l_extendedprice) * l_quantity) AS g1,
                 avg(2 * (900.0::DOUBLE * l_quantity + 5 - l_extendedprice)) AS g0 FROM lineitem GROUP BY 1)
    SELECT round(avg(g1), 2) AS g_slope, round(avg(g0), 4) AS g_intercept, count(*) AS shards FROM g""",
)
def mean_gradient(t: Tables):
    out = fit.mean_gradient(t.raw("lineitem"), F.col("l_orderkey") % 7, "l_quantity", "l_extendedprice", 900.0, 5.0)
    return out.select(F.round("g_slope", 2).alias("g_slope"), F.round("g_intercept", 4).alias("g_intercept"), "shards")


@query("M07_shard_by_rank", "SELECT o_orderkey AS k, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 6 AS INT) AS rank FROM orders")
def shard_by_rank(t: Tables):
    return fit.shard_of(t.raw("orders").select(F.col("o_orderkey").alias("k")), ["k"], 6)


@query(
    "M08_batch_number",
    """SELECT k, step, step < 10000 // 3 AS runs
    FROM (SELECT o_orderkey AS k, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // (1 * 3) AS BIGINT) AS step FROM orders) x""",
)
def batch_number(t: Tables):
    rows = t.raw("orders").select(F.col("o_orderkey").alias("k"))
    return fit.batch_of(rows, ["k"], per_worker=1, workers=3, step_budget=10_000)


@query(
    "M09_gang_run",
    "SELECT true AS whole_gang, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem",
)
def gang_run(t: Tables):
    """As many members as the cluster has slots, each reducing its share of the rows."""

    def work(batches, rank, addresses):
        n = total = 0
        for b in batches:
            n, total = n + len(b), total + int(b["l_linenumber"].sum())
        yield pd.DataFrame({"rank": [rank], "members": [len(addresses)], "n": [n], "total": [total]})

    parts = program.gang_run(
        t.raw("lineitem").select("l_linenumber"), t.spark.sparkContext.defaultParallelism, work,
        "rank int, members bigint, n bigint, total bigint",
    )
    whole = (F.min("members") == F.count(F.lit(1))) & (F.max("rank") + 1 == F.max("members"))
    return parts.agg(whole.alias("whole_gang"), F.sum("n").alias("n"), F.sum("total").alias("total"))


SCORE_SQL = """
    s AS (SELECT vec_id, label, vec_id % 3 AS epoch, vec_id % 4 = 0 AS is_test, embedding[1:10] AS scores FROM embeddings),
    e AS (SELECT *, list_position(scores, list_max(scores)) - 1 = label AS hit,
              ln(list_sum(list_transform(scores, lambda x: exp(x::DOUBLE)))) - scores[label + 1]::DOUBLE AS loss FROM s)"""


def _scored(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(
        "label", (F.col("vec_id") % 3).alias("epoch"), (F.col("vec_id") % 4 == 0).alias("is_test"),
        F.slice("embedding", 1, 10).alias("scores"),
    )


@query(
    "M10_epoch_table",
    f"""{SCORE_SQL}
    SELECT epoch, round(avg(loss) FILTER (WHERE NOT is_test), 6) AS train_loss, round(avg(hit::DOUBLE) FILTER (WHERE NOT is_test), 6) AS train_acc,
           round(avg(loss) FILTER (WHERE is_test), 6) AS test_loss, round(avg(hit::DOUBLE) FILTER (WHERE is_test), 6) AS test_acc FROM e GROUP BY epoch""",
)
def epoch_table(t: Tables):
    out = fit.epoch_table(_scored(t))
    return out.select("epoch", *(F.round(c, 6).alias(c) for c in out.columns if c != "epoch"))


@query(
    "G20_weighted_mean",
    "SELECT l_returnflag AS flag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1",
)
def weighted_mean(t: Tables):
    return t.raw("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(fit.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean")
    )


@query("G21_accuracy", f"{SCORE_SQL} SELECT epoch, round(avg(hit::INT), 6) AS accuracy FROM e GROUP BY epoch")
def accuracy(t: Tables):
    return _scored(t).groupBy("epoch").agg(F.round(fit.accuracy("scores", "label"), 6).alias("accuracy"))


@query("X01_external_program", "SELECT upper(concat(o_orderkey, ' ', o_orderpriority, ' ', lower(o_orderstatus))) AS line FROM orders")
def external_program(t: Tables):
    rows = t.raw("orders").select(
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", F.lower("o_orderstatus")).alias("text")
    )
    return program.run_program(rows, ["tr", "a-z", "A-Z"], "text", env={"LC_ALL": "C"}, timeout_s=3600)
