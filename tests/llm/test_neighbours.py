"""Nearest neighbours against brute force."""

from collections import Counter

import numpy as np

from runledger.llm.neighbours import cell_of, chi_square_quantile, nearest, splits

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(chi_square_quantile(0.5, 2) - 1.386) < 1e-3


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = brute(ids, x), nearest(table).collect()
    assert Counter(r.query_id for r in got) == {i: 20 for i in want}
    hits = sum((r.vec_id, True) in {(v, True) for v, _ in want[r.query_id]} for r in got)
    assert hits >= 0.95 * len(got)
    place = {v: i for i, v in enumerate(ids)}
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - x[place[q]] @ x[place[r.vec_id]]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_copies_and_bad_vectors(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 6)).astype(np.float32)
    x[100:260] = 4 * x[100]
    x[300:303] *= 5
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)]
    bad = [(1000, None, 0), (1020, [0.0] * 6, 0), (1040, [1.0, None] + [0.0] * 4, 0), (1060, [float("nan")] * 6, 0), (None, [1.0] * 6, 0),
           (1080, [float("inf")] + [0.0] * 5, 0), (1100, [1.0], 0), (1120, [], 0)]
    df = spark.createDataFrame(rows + bad + rows[:7], SCHEMA)
    got, want = nearest(df).collect(), brute(np.arange(400), x.astype(np.float64))
    assert {r.query_id for r in got} == set(want)
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 400 and hits >= 0.97 * 400
    near = sorted((r for r in got if r.query_id == 120), key=lambda r: r.rank)
    assert [r.vec_id for r in near] == [v for v, _ in want[120]]
    few = nearest(df.where("vec_id in (0, 3, 5)")).collect()
    assert {(r.query_id, r.rank) for r in few} == {(0, 1), (0, 2)}
    assert nearest(df.where("vec_id = 20")).count() == nearest(df.limit(0)).count() == 0


def test_many_cells_levels_and_blocks_give_the_same(spark):
    random = np.random.default_rng(11)
    middles = random.normal(size=(6, 12))
    x = (middles[random.integers(0, 6, 6000)] + 0.2 * random.normal(size=(6000, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(6000)], SCHEMA)
    want = brute(np.arange(6000), x.astype(np.float64))
    for how in ({}, {"cell_rows": 60, "top": 3, "block": 8}):
        got = nearest(df, **how).collect()
        assert Counter(r.query_id for r in got) == {i: 20 for i in want}
        assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) >= 0.95 * len(got)


def test_cells_of_levels_are_those_of_one_tree():
    x = np.random.default_rng(5).normal(size=(3000, 4))
    whole = splits(x, 6)
    one = [(np.array([[d for d, _ in whole]]), np.array([[v for _, v in whole]]))]
    upper = splits(x, 2)
    levels = [(np.array([[d for d, _ in upper]]), np.array([[v for _, v in upper]]))]
    below = [splits(x[cell_of(x, levels) == c], 4) for c in range(4)]
    levels.append((np.array([[d for d, _ in t] for t in below]), np.array([[v for _, v in t] for t in below])))
    assert (cell_of(x, one) == cell_of(x, levels)).all() and len(np.unique(cell_of(x, one))) == 64
