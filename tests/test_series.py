"""Split series and hot-key joins give what the plain forms give."""

import random

import pytest
from oracle import DATA, compare, connect
from pyspark.sql import functions as F

from runledger.operators.series import Series
from runledger.operators.skew import dim_join, has_hot_key, hot_values
from runledger.plans.catalog import ORACLES, QUERIES
from runledger.plans.tables import Tables


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = [
        (0 if i % 3 == 0 else rng.randrange(200), rng.randrange(400), i, rng.choice([None, 1.5, 2.5, -1.0]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k int, ts int, id int, v double")


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_equals_plain(spark, keys):
    def build(hot):
        s = Series(skewed(spark), keys, ["ts", "id"], hot=hot, chunks=7)
        s = s.row_number("rn").running(total=F.col("v"), ones=F.lit(1).cast("long"))
        s = s.previous(p_v=F.col("v"), p_id=F.col("id"))
        s = s.total(whole=F.lit(1).cast("long"), v_sum=F.col("v"))
        return s.last_seen(seen=F.col("v"), even=F.when(F.col("id") % 2 == 0, F.col("id"))).df

    assert rows_of(build(True)) == rows_of(build(False))


def test_a_border_cuts_one_key(spark):
    s = Series(skewed(spark), ["k"], ["ts", "id"], hot=True, chunks=7)
    carry = s._carry({"n": F.sum(F.lit(1))}, {"n": F.sum("n")})
    assert 0 < carry.count() < 7


def test_hot_values(spark):
    df = skewed(spark)
    assert hot_values(df, "k", rows=900) == [0]
    assert hot_values(df, "k", rows=5000) == []
    assert has_hot_key(df, ["k"], rows=900)
    assert not has_hot_key(df, ["id"], rows=900)
    assert has_hot_key(df, [], rows=900)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    df = skewed(spark)
    dim = spark.range(0, 150).selectExpr("cast(id as int) as k", "id * 10 as w")
    plain = df.join(dim, "k", how)
    assert rows_of(dim_join(df, dim, "k", how, hot=[0, 3, 199])) == rows_of(plain)
    assert rows_of(dim_join(df, dim, "k", how)) == rows_of(plain)


ORDERED = [
    "W01_attempt_number", "F08_current_attempt", "J06_task_lifecycle", "J01_logs_with_user", "J05_slot_assignment",
    "J07_as_of_metrics", "J08_arrival_matching", "W03_rank_plan", "W04_local_sequence", "W07_heartbeat_gap",
    "W08_dependency_countdown", "W09_failure_runs", "W05_changed_snapshot", "W06_every_twentieth", "O02_attention_order",
    "O03_task_id_order", "G11_running_average", "G17_status_summary", "T03_liveness_sessions", "T08_metric_state",
    "T11_changes", "T13_dependency_countdown_stream",
]


@pytest.mark.parametrize("name", ORDERED)
def test_queries_with_hot_keys(spark, monkeypatch, name):
    """The queries again as if some keys were hot: results must not change."""
    sf_dir = f"{DATA}/sf0.001"
    hot = {"l_orderkey": [1, 2, 3, 5, 700], "o_custkey": [10, 11], "user_id": [1, 2, 3]}
    monkeypatch.setattr(Tables, "_hot_values", lambda self, table, column: hot[column])
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None
