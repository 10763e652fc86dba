"""Hard negatives against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from runledger.llm import negatives
from runledger.llm.negatives import NEGATIVES_SQL, angles, directions, hard_negatives, score_bounds, scores
from runledger.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    """Plain loops over whole numbers."""
    kept = []
    for i, v, g in rows:
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, g, tuple(max(-negatives.INT, min(negatives.INT, math.floor(256 * float(np.float32(x))))) for x in v)))
    anchors = {}
    for r in kept:
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], (*r[:2], tuple(r[2]))), r, key=lambda r: (r[1],))
    out = Counter()
    for i, g, v in anchors.values():
        score = lambda w: max(-negatives.LONG, min(negatives.LONG, sum(a * b for a, b in zip(v, w))))
        every_one = sorted((-score(w), j, h) for j, h, w in kept)
        near = [(j, -s) for s, j, h in every_one if h == g and j != i][:5]
        for j, p in near:
            far = [(k, -s) for s, k, h in every_one if h != g and 80 * p <= -100 * s <= 100 * p][:5]
            for rank, (k, s) in enumerate(far, 1):
                out[i, j, rank, k, p, s] += 1
    return out


def got(df, **settings):
    return Counter(tuple(r) for r in hard_negatives(df, **settings).collect())


def test_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op12_angular_negatives"](spark, sf_dir)
    assert compare(df, connect(sf_dir), NEGATIVES_SQL) is None
    assert df.dtypes == [(c, "int" if c == "rank" else "bigint") for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]


@pytest.mark.parametrize("cell_rows", [16_384, 40])
def test_clusters_copies_and_bad_rows(spark, cell_rows):
    random = np.random.default_rng(5)
    middle = random.normal(size=(12, 8))
    x = (middle[random.integers(0, 12, 900)] + 0.1 * random.normal(size=(900, 8))).astype(np.float32)
    x[300:500] = x[300]
    x[600:610] *= 40
    rows = [(i, [float(v) for v in x[i]], int(i) % 3) for i in range(900)]
    bad = [(1000, None, 0), (1100, [1.0, None] + [0.0] * 6, 0), (1200, [float("nan")] * 8, 0), (1300, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 0),
           (1400, [1.0] * 8, None), (1500, [0.0] * 8, 1), (1501, [0.0] * 8, 2), (1600, [1.0, 2.0], 0), (1700, [], 1), (1601, [1.5, 2.0], 0)]
    rows += bad + rows[:20] + rows[310:315]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label AS block", "vec_id AS x", "label AS kind", "label AS score")
    assert got(df.repartition(7), every=25, cell_rows=cell_rows) == brute(rows, 25)


def test_large_numbers(spark):
    random = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in random.normal(size=3) * 10.0 ** (i % 12)], i % 2) for i in range(150)] + [(200, [1e38, 1e30, -1e38], 0)]
    assert got(spark.createDataFrame(rows, SCHEMA), every=10) == brute(rows, 10)


def test_small_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).count() == 0 and hard_negatives(empty).columns[0] == "anchor_id"
    zeros = [(100 * i, [0.0, 0.0], i % 2) for i in range(6)]
    assert got(spark.createDataFrame(zeros, SCHEMA)) == brute(zeros)
    one = [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)]
    assert got(spark.createDataFrame(one, SCHEMA)) == brute(one) == Counter({(0, 1, 1, 2, 65536, 58880): 1})
    assert got(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == Counter()


def test_bounds_hold():
    random = np.random.default_rng(2)
    x = np.concatenate([random.integers(-300, 300, (200, 5)), np.zeros((1, 5)), random.integers(-9, 9, (50, 1)) * np.array([[3, 1, 4, 1, 5]])]).astype(float)
    norm, p = angles(x, directions(x, 6))
    p = p.astype(np.float32).astype(float)
    least, most = score_bounds(p[:40], norm[:40], p, p, norm, norm)
    exact = scores(x[:40], x)
    assert (least <= exact).all() and (exact <= most).all() and (most - least).mean() < 2 * (norm[:40, None] * norm).mean()
    assert directions(np.zeros((3, 4))).shape == (0, 4)
