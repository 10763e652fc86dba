"""Approximate nearest neighbours by few stable projections, a kd-tree and a chi-square stopping test.

Largest inner products become smallest distances by one more component, sqrt(M^2 - |x|^2), that makes all vectors
equally long. A Gaussian (2-stable) matrix projects to ``DIMS`` numbers; a projected squared distance
divided by the true one is chi-square with as many degrees of freedom. A point whose projected squared
distance is above quantile(``SURE``) times the squared distance of the k-th neighbour found so far is therefore nearer
than that neighbour with a probability below 1 - ``SURE``, and the search stops.

The upper levels of the kd-tree are the cells that all points are dealt out to; the rest of the tree is built inside a
cell. Cells are split at medians of a sample, ``TOP`` levels at a time: a task splits one cell of the levels above with
about ``SAMPLE`` rows for each new cell, so that the driver gets two numbers a split and no vector. A query searches its own cell first. With the
distance found there, it goes on only to cells whose box passes the test, and inside a cell through
the leaves in order of projected distance until the test holds. A cell's points go to one task for each block of
queries that ask for this cell, so what is shuffled grows with the pairs of query and cell and not with points times queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import written

DIMS = 8
SURE = 0.97
LEAF = 64
CELL_ROWS = 16_384
LEAST_CELLS = 32
SAMPLE = 512  # rows for each cell, to place the splits
TOP = 8
QUERY_BLOCK = 32_768  # queries that one task holds beside the points of a cell
SLICE = 4_096  # of them searched at a time
NEAR = 2**22  # distances of queries to boxes at a time


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom, where the distribution has a closed form."""
    low, high = 0.0, 1e3
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


class Projection:
    def __init__(self, width: int, longest: float, dims: int = DIMS, seed: int = 7):
        self.matrix = np.random.default_rng(seed).standard_normal((width + 1, dims))
        self.square = longest

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete tree of 2**depth cells as (dimension, value), the children of i at 2i + 1 and 2i + 2."""
    tree, parts = [], [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            dim = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, dim])) if len(part) else 0.0
            tree.append((dim, value))
            below += [part[part[:, dim] <= value], part[part[:, dim] > value]]
        parts = below
    return tree


def cell_of(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The cell of each row: each level has a tree (as a row of dimensions and one of values) for each cell of the levels above."""
    cell = np.zeros(len(x), int)
    for dims, values in levels:
        at = np.zeros(len(x), int)
        for _ in range((dims.shape[1] + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[np.arange(len(x)), dims[cell, at]] > values[cell, at])
        cell = cell * (dims.shape[1] + 1) + at - dims.shape[1]
    return cell


def tree_levels(points: DataFrame, project: Projection, width: int, n: int, depth: int, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Splits of 2**depth cells for ``cell_of``, ``top`` levels at a time."""
    levels, done = [], 0
    while done < depth:
        step, cells = min(top, depth - done), 2**done

        def dealt(frames):
            for f in frames:
                x = project.points(np.array(f["x"].tolist(), np.float64).reshape(-1, width))
                yield pd.DataFrame({"cell": cell_of(x, levels), "p": list(x)})

        def split(g):
            tree = splits(np.array(g["p"].tolist()).reshape(len(g), -1), step)
            return pd.DataFrame({"cell": g["cell"].iloc[:1], "dims": [[d for d, _ in tree]], "values": [[v for _, v in tree]]})

        share = min(1.0, 1.2 * SAMPLE * 2 ** (done + step) / max(n, 1))
        found = (
            points.select("x").sample(share, seed=7 + done).mapInPandas(dealt, "cell int, p array<double>")
            .groupBy("cell").applyInPandas(split, "cell int, dims array<int>, values array<double>").collect()
        )
        dims, values = np.zeros((cells, 2**step - 1), int), np.zeros((cells, 2**step - 1))
        for r in found:
            dims[r["cell"]], values[r["cell"]] = r["dims"], r["values"]
        levels, done = [*levels, (dims, values)], done + step
    return levels


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows of ``x`` by leaf of a kd-tree, split at the median of the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        by = rows[np.argsort(x[rows, np.argmax(np.ptp(x[rows], axis=0))], kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2:]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries (rows) to boxes (columns)."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search(q, qp, bound, x, xp, first_id, k, square, quantile):
    """For each query the ``k`` best rows of ``x`` that the incremental search verifies, and their products.

    ``bound``: products of the k-th neighbours known before. Missing places hold -1 and minus infinity.
    """
    parts = leaves(xp)
    near = box_distance(qp, np.array([xp[r].min(axis=0) for r in parts]), np.array([xp[r].max(axis=0) for r in parts]))
    order = np.argsort(near, axis=1, kind="stable")
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    lengths = np.einsum("ij,ij->i", q, q)
    active = np.arange(len(q))
    for step in range(len(parts)):
        leaf = order[active, step]
        kth = np.maximum(best[active, -1], bound[active])
        far = np.maximum(lengths[active] + square - 2 * kth, 0)
        active, leaf = (a[near[active, leaf] <= quantile * far] for a in (active, leaf))
        if not len(active):
            break
        for one in np.unique(leaf):
            at, rows = active[leaf == one], parts[one]
            score = np.concatenate([best[at], q[at] @ x[rows].T], axis=1)
            names = np.concatenate([who[at], np.broadcast_to(rows, (len(at), len(rows)))], axis=1)
            ties = np.where(names >= 0, first_id[names], np.iinfo(np.int64).max)
            top = np.lexsort((ties, -score), axis=1)[:, :k]
            best[at], who[at] = np.take_along_axis(score, top, 1), np.take_along_axis(names, top, 1)
    return best, who


def valid(vector: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS, top: int = TOP, block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query, nearest first, ties to smaller ids.

    Queries: rows whose identifier is divisible by ``every``. score: inner product in double precision. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do rows without an identifier,
    nor vectors of another length than the one with the smallest identifier. Rows of equal vectors are one
    point, of which the k + 1 smallest identifiers count: no other can be among the k nearest. Rows repeated
    with their identifier count once. Empty tables give no rows; other columns are not returned. ``cell_rows``, ``top``
    and ``block`` bound what a task holds: points of a cell, levels split at a time, queries beside a cell.
    """
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(valid("x") & F.col("vec_id").isNotNull())
    first = rows.agg(F.min_by(F.size("x"), "vec_id")).first()[0]
    if first is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == first).withColumn("_h", F.xxhash64("x"))
    queries = written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").dropDuplicates(["query_id"]), "op7-queries")
    smallest = Window.partitionBy("_h", "x").orderBy("vec_id")
    points = written(
        rows.dropDuplicates(["vec_id"]).withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1)
        .groupBy("_h", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).drop("_h"),
        "op7-points",
    )
    n, square = points.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()
    project, quantile = Projection(first, square), chi_square_quantile(SURE)
    depth = max(LEAST_CELLS.bit_length() - 1, math.ceil(math.log2(max(1, n / cell_rows))))
    tree = tree_levels(points, project, first, n, depth, top)
    matrix = lambda column: np.array(column.tolist(), np.float64).reshape(-1, first)

    def dealt(frames):
        for f in frames:
            yield f.assign(cell=cell_of(project.points(matrix(f["x"])), tree))

    dealt_points = written(points.mapInPandas(dealt, "x array<double>, ids array<long>, cell int"), "op7-cells")

    def box(frames):
        for f in frames:
            xp = pd.DataFrame(project.points(matrix(f["x"]))).assign(cell=f["cell"])
            for cell, g in xp.groupby("cell"):
                g = g.drop(columns="cell").to_numpy()
                yield pd.DataFrame({"cell": [cell], "low": [g.min(axis=0)], "high": [g.max(axis=0)]})

    sides = [F.min(F.col("low")[d]).alias(f"l{d}") for d in range(DIMS)] + [F.max(F.col("high")[d]).alias(f"h{d}") for d in range(DIMS)]
    boxes = dealt_points.mapInPandas(box, "cell int, low array<double>, high array<double>").groupBy("cell").agg(*sides).collect()
    cells = np.array([r["cell"] for r in boxes])  # 16 numbers for each ``cell_rows`` points
    low, high = (np.array([[r[f"{side}{d}"] for d in range(DIMS)] for r in boxes]).reshape(-1, DIMS) for side in "lh")

    def routed(f, first_round):
        """Positions of queries in ``f`` and of the cells that they go to, some queries at a time."""
        step = max(1, NEAR // len(cells))
        for start in range(0, len(f), step):
            part = f.iloc[start:start + step]
            q = matrix(part["x"])
            near = box_distance(project.queries(q), low, high)
            home = near.argmin(axis=1)
            if first_round:
                at, to = np.arange(len(q)), home
            else:
                far = np.maximum(np.einsum("ij,ij->i", q, q) + square - 2 * part["bound"].to_numpy(), 0)
                more = near <= quantile * far[:, None]
                more[np.arange(len(q)), home] = False
                at, to = np.nonzero(more)
            yield part.iloc[at], to

    def counted(first_round):
        def run(frames):
            n_asked = np.zeros(len(cells), np.int64)
            for f in frames:
                for _, to in routed(f, first_round):
                    n_asked += np.bincount(to, minlength=len(cells))
            some = np.flatnonzero(n_asked)
            yield pd.DataFrame({"cell": cells[some], "n": n_asked[some]})
        return run

    def route(first_round, blocks):
        def run(frames):
            for f in frames:
                for asked, to in routed(f, first_round):
                    number = asked["query_id"].to_numpy() // every % blocks[cells[to]]
                    yield asked.assign(cell=cells[to], block=number)[["query_id", "x", "bound", "cell", "block"]]
        return run

    def found(points_in, queries_in):
        if not len(points_in) or not len(queries_in):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "score": np.empty(0), "ids": np.empty(0, object)})
        x = matrix(points_in["x"])
        xp, ids = project.points(x), points_in["ids"].to_numpy()
        first_id, out = np.array([i[0] for i in ids]), []
        for start in range(0, len(queries_in), SLICE):
            part = queries_in.iloc[start:start + SLICE]
            q, bound = matrix(part["x"]), part["bound"].to_numpy()
            score, who = search(q, project.queries(q), bound, x, xp, first_id, k + 1, square, quantile)
            at, place = np.nonzero((who >= 0) & (score >= bound[:, None]))
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[at], "score": score[at, place], "ids": ids[who[at, place]]}))
        return pd.concat(out)

    def searched(asked, first_round):
        """Counts what each cell is asked for, then sends its points to as many blocks as that fills and no others."""
        wanted = asked.mapInPandas(counted(first_round), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        blocks = np.zeros(2**depth, np.int64)
        for r in wanted.collect():  # one number for each ``cell_rows`` points
            blocks[r["cell"]] = -(-r["n"] // block)

        def copied(frames):
            for f in frames:
                times = blocks[f["cell"].to_numpy()]
                at = np.repeat(np.arange(len(f)), times)
                yield f.iloc[at].assign(block=np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times))

        sent = asked.mapInPandas(route(first_round, blocks), "query_id long, x array<double>, bound double, cell int, block int")
        spread = dealt_points.mapInPandas(copied, "x array<double>, ids array<long>, cell int, block int")
        return spread.groupBy("cell", "block").cogroup(sent.groupBy("cell", "block")).applyInPandas(found, "query_id long, score double, ids array<long>")

    asked = queries.withColumn("bound", F.lit(float("-inf")))
    home = written(searched(asked, True), "op7-home")
    kth = home.groupBy("query_id").agg(F.min("score").alias("m"), F.count(F.lit(1)).alias("c"))
    bound = F.when(F.col("c") > k, F.col("m")).otherwise(F.lit(float("-inf")))
    asked = written(queries.join(kth, "query_id", "left").select("query_id", "x", bound.alias("bound")), "op7-asked")
    both = home.unionByName(searched(asked, False))
    each = both.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
