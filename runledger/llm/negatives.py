"""Hard-negative mining with angular triangle filtering.

Every vector is stored with its norm and its angles to a few reference directions. For an anchor at angle p to a
direction and a row at angle t, the angle between the two is at least |p - t| and at most min(p + t, 2 pi - p - t). Over
all directions this gives an interval of the cosine and, times both norms, bounds of the score, widened by more
than rounding can move them. Only rows whose bounds overlap a window of scores wanted are scored, in whole numbers.

Rows lie in cells: nearest direction, then a range of the angle to it. A cell has bounds of its own from the intervals of
its rows' angles and norms, so a window is asked for only in cells that can hold it. Cells beyond ``CELL_ROWS`` rows are
cut into blocks by a hash. An anchor asks twice: for its positives, with the score of its last positive in a bounded
sample as the least score wanted; and for negatives, in the windows that its positives set.

A block's rows and the questions put to it meet in one partition, sorted so that the rows (about ``CELL_ROWS`` at most) come
first and the questions, however many, stream past them in Arrow batches. Rows are dealt out once a round and never copied; a
question goes to each block it must see. The directions come from a sample of ``SAMPLE`` rows; every row is searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import map_batches
from runledger.session import written

DIRECTIONS = 16
SAMPLE = 1_024
BINS = 64
LEAST_ROWS, CELL_ROWS = 2_048, 16_384
STEP = 64
#: Cosines of bounds are widened by this; stored angles are good to about 2e-7.
SLACK = 2e-6
#: Products of whole numbers below this are exact in doubles.
EXACT = 2.0**52
INT, LONG = 2**31 - 1, 2**63 - 1

ROW = "block int, kind int, vec_id long, label long, x binary, norm double, angles array<float>, positives array<long>, floor double"


def complete(vector: str) -> Column:
    """Not null, and every component a finite number."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each list, held within four bytes; places beyond the end of a list are zero."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    with np.errstate(over="ignore"):
        out[np.arange(width) < lengths[:, None]] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
    return np.clip(out, -INT, INT)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.float64).reshape(len(column), width)


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def directions(sample: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors far from one another, taken from the sample one by one, from its first row on."""
    length = np.linalg.norm(sample, axis=1)
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < n and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the directions; a zero vector is taken to be at a right angle to all."""
    norm = np.linalg.norm(x, axis=1)
    cosine = np.divide(x @ to.T, norm[:, None], out=np.zeros((len(x), len(to))), where=norm[:, None] > 0)
    return norm, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(p, norm, low, high, least, most):
    """Bounds of the scores between anchors (rows) and rows or cells (columns).

    ``p`` and ``norm``: angles and norms of the anchors. ``low`` and ``high``: least and largest angle of each column to
    each direction, ``least`` and ``most`` its least and largest norm. A single row has equal ones.
    """
    nearest, farthest = np.zeros((len(p), len(low))), np.full((len(p), len(low)), np.pi)
    for j in range(p.shape[1]):
        a, b, c = p[:, j, None], low[None, :, j], high[None, :, j]
        np.maximum(nearest, np.maximum(b - a, a - c), out=nearest)
        np.minimum(farthest, np.minimum(a + c, 2 * np.pi - a - b), out=farthest)
    best, worst = np.cos(nearest) + SLACK, np.cos(np.maximum(farthest, nearest)) - SLACK
    long, short = norm[:, None] * most, norm[:, None] * least
    lower, upper = np.where(worst < 0, worst * long, worst * short) - 1, np.where(best > 0, best * long, best * short) + 1
    return np.clip(lower, -LONG, LONG), np.clip(upper, -LONG, LONG)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; in Python's integers, held at the ends of a long, where doubles end."""
    if not len(a) or not len(b) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: x.astype(np.int64).astype(object)
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)


class Block:
    """Rows or questions of one block."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, n: int):
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.ids, self.labels, self.norm = (table.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
        self.x, self.angles = _vectors(table.column("x"), width), _lists(table.column("angles"), n)
        self.table = table

    def near(self, asked: Block, low: np.ndarray, high: np.ndarray):
        """For each question the rows whose score bounds overlap one of its windows (rows of ``low``, ``high``)."""
        for start in range(0, len(asked.ids), STEP):
            at = slice(start, start + STEP)
            least, most = score_bounds(asked.angles[at], asked.norm[at], self.angles, self.angles, self.norm, self.norm)
            for i in range(len(least)):
                overlap = np.zeros(len(self.ids), bool)
                for a, b in zip(low[start + i], high[start + i]):  # a window left out is not a number and overlaps nothing
                    overlap |= (most[i] >= a) & (least[i] <= b)
                yield start + i, overlap

    def ranked(self, asked: Block, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of ``rows`` for question ``i``, best first."""
        score = scores(asked.x[i: i + 1], self.x[rows])[0]
        order = np.lexsort((self.ids[rows], -score))
        return self.ids[rows][order], score[order]

    def positives(self, asked: Block, k: int):
        """Up to ``k`` rows of each anchor's label that can be among its best."""
        low = asked.table.column("floor").to_numpy()[:, None]
        for i, overlap in self.near(asked, low, np.full_like(low, np.inf)):
            ids, score = self.ranked(asked, i, np.flatnonzero(overlap & (self.labels == asked.labels[i]) & (self.ids != asked.ids[i])))
            yield from ((asked.ids[i], 0, a, b) for a, b in zip(ids[:k], score[:k]))

    def negatives(self, asked: Block, k: int, share: tuple[int, int]):
        """For each positive score up to ``k`` rows of other labels, best first, between the shares of that score."""
        wanted = asked.table.column("positives").to_pylist()
        low, high = (np.full((len(wanted), max(map(len, wanted))), np.nan) for _ in range(2))
        for i, w in enumerate(wanted):
            low[i, : len(w)], high[i, : len(w)] = np.array(w) * (share[0] / 100), np.array(w) * (share[1] / 100)
        for i, overlap in self.near(asked, low, high):
            ids, score = self.ranked(asked, i, np.flatnonzero(overlap & (self.labels != asked.labels[i])))
            for p in wanted[i]:
                # In whole numbers: share[0] * p <= 100 * score <= share[1] * p.
                inside = np.flatnonzero((score >= -(-share[0] * p // 100)) & (score <= share[1] * p // 100))[:k]
                yield from ((asked.ids[i], p, ids[j], score[j]) for j in inside)


def _met(rows: DataFrame, questions: DataFrame, answer, width: int, n: int) -> DataFrame:
    """Puts the questions of each block to its rows: anchor_id, positive_score, vec_id, score."""
    names = ["anchor_id", "positive_score", "vec_id", "score"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        block, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if keys[0, a] != block:
                    block, held, ready = keys[0, a], [], None
                if keys[1, a] == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    ready, held = Block(held, width, n), []
                found = list(answer(ready, Block([part], width, n))) if ready else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    both = rows.unionByName(questions).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Cells:
    """Cells of whole bins of one direction each, with the bounds of their rows, and the blocks they are cut into."""

    def __init__(self, bins: list, n: int, cell_rows: int):
        """``bins``: direction, bin, rows, least, most, low (list), high (list) of every bin that has rows."""
        self.place, cells = np.full(max(n, 1) * BINS, -1), []
        for r in sorted(bins, key=lambda r: (r["direction"], r["bin"])):
            last = cells[-1] if cells else None
            one = [r["rows"], r["least"], r["most"], np.array(r["low"], float), np.array(r["high"], float), r["direction"]]
            if last and last[5] == r["direction"] and last[0] < min(LEAST_ROWS, cell_rows):
                cells[-1] = [last[0] + one[0], min(last[1], one[1]), max(last[2], one[2]), np.minimum(last[3], one[3]), np.maximum(last[4], one[4]), last[5]]
            else:
                cells.append(one)
            self.place[r["direction"] * BINS + r["bin"]] = len(cells) - 1
        self.blocks = np.array([-(-c[0] // cell_rows) for c in cells], int)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.least, self.most = (np.array([c[i] for c in cells], float) for i in (1, 2))
        self.low, self.high = (np.array([c[i] for c in cells]).reshape(len(cells), n) for i in (3, 4))

    def targets(self, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, block) for each anchor (row) and all blocks of the cells (columns) marked."""
        at, cell = np.nonzero(overlap)
        times = self.blocks[cell]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), np.repeat(self.first[cell], times) + inside


def _asked(anchors: DataFrame, cells: Cells, width: int, n: int, windows) -> DataFrame:
    """Questions: a row of each anchor for each block of the cells that can hold one of its windows."""

    def run(batch: pa.RecordBatch):
        norm, p = batch.column("norm").to_numpy(), _lists(batch.column("angles"), n)
        low, high = windows(batch)
        for start in range(0, batch.num_rows, STEP):
            at = slice(start, start + STEP)
            least, most = score_bounds(p[at], norm[at], cells.low, cells.high, cells.least, cells.most)
            overlap = np.zeros(least.shape, bool)
            for a, b in zip(low[at].T, high[at].T):
                overlap |= (most >= a[:, None]) & (least <= b[:, None])
            who, block = cells.targets(overlap)
            rows = batch.take(pa.array(who + start))
            yield {f: rows.column(f) for f in rows.schema.names} | {"block": block, "kind": np.ones(len(block), np.int32)}

    return map_batches(anchors, run, ROW)


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100,
    n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100), cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose identifier is divisible by ``every``. A score is the inner product of floor(256 * x) of both vectors, higher
    first, ties by smaller identifier. An anchor's positives are its first rows of the same label. For each, the first rows of other
    labels that score between ``share`` percent of it are its hard negatives.

    Rows with a null identifier, label or vector, or with a null or non-finite component, take no part. Zero and empty vectors
    score 0 with all; a vector shorter than others goes on in zeros. An anchor whose identifier occurs several times is the smallest
    of these rows (label, then vector), and rows of its identifier are not its positives; otherwise rows of one identifier
    count each. Components are held within four bytes, scores within a long. Empty tables give no rows; other columns are not returned.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & complete("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "v").limit(SAMPLE).toArrow().combine_chunks()
    known, known_ids, known_labels = quantised(sample.column("v").combine_chunks(), width), sample.column("vec_id").to_numpy(), sample.column("label").to_numpy()
    to = directions(known)
    n = len(to)

    def store(batch: pa.RecordBatch) -> dict:
        x = quantised(batch.column("v"), width)
        norm, p = angles(x, to)
        home = p.argmin(axis=1) if n else np.zeros(len(x), int)
        nearest = p[np.arange(len(x)), home] if n else np.zeros(len(x))
        return {
            "vec_id": batch.column("vec_id"), "label": batch.column("label"), "x": [r.tobytes() for r in x.astype("<i4")], "norm": norm,
            "angles": list(p.astype(np.float32)), "direction": home, "bin": np.minimum((nearest / np.pi * BINS).astype(int), BINS - 1),
        }

    stored = written(map_batches(rows, store, "vec_id long, label long, x binary, norm double, angles array<float>, direction int, bin int"), "op12-rows")
    sides = [f(F.col("angles")[j]) for f in (F.min, F.max) for j in range(n)]
    bins = stored.groupBy("direction", "bin").agg(  # DIRECTIONS * BINS rows at most
        F.count(F.lit(1)).alias("rows"), F.min("norm").alias("least"), F.max("norm").alias("most"),
        F.array(*sides[:n]).alias("low"), F.array(*sides[n:]).alias("high"),
    ).collect()
    cells = Cells(bins, n, cell_rows)
    table = spark.createDataFrame(
        [(i // BINS, i % BINS, int(cells.first[c]), int(cells.blocks[c])) for i, c in enumerate(cells.place) if c >= 0], "direction int, bin int, _first int, _blocks int"
    )
    # A row's own number, so that rows repeated with their identifier are cut as well.
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_blocks"))
    nothing = {"positives": F.lit(None).cast("array<long>"), "floor": F.lit(None).cast("double")}
    dealt = stored.join(F.broadcast(table), ["direction", "bin"]).withColumns({"block": (F.col("_first") + number).cast("int"), "kind": F.lit(0), **nothing})
    columns = [c.split()[0] for c in ROW.split(", ")]
    dealt = dealt.select(*columns)
    own = stored.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x", "norm", "angles")).alias("r"))
    anchors = written(own.select("vec_id", "r.*"), "op12-anchors")

    def floors(batch: pa.RecordBatch) -> dict:
        """The score of the last positive among the sampled rows, which the last of all rows reaches at least."""
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        score = scores(_vectors(batch.column("x"), width), known)
        allowed = (labels[:, None] == known_labels) & (ids[:, None] != known_ids)
        score = np.where(allowed, score.astype(float), -np.inf)
        last = np.sort(score, axis=1)[:, -n_positives] if len(known) >= n_positives else np.full(len(ids), -np.inf)
        same = {f: batch.column(f) for f in ("vec_id", "label", "x", "norm", "angles")}
        return same | {"block": [None] * len(ids), "kind": [None] * len(ids), "positives": [None] * len(ids), "floor": last}

    def above(batch):
        low = batch.column("floor").to_numpy()[:, None]
        return low, np.full_like(low, np.inf)

    def between(batch):
        wanted = batch.column("positives").to_pylist()
        low, high = (np.full((len(wanted), max(map(len, wanted), default=0)), np.nan) for _ in range(2))
        for i, w in enumerate(wanted):
            low[i, : len(w)], high[i, : len(w)] = np.array(w) * (share[0] / 100), np.array(w) * (share[1] / 100)
        return low, high

    first = _met(dealt, _asked(map_batches(anchors, floors, ROW), cells, width, n, above), lambda b, q: b.positives(q, n_positives), width, n)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = written(
        first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n_positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "op12-positives",
    )
    wanted = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("positives"))
    asking = anchors.join(wanted, "vec_id").withColumns({"block": F.lit(0), "kind": F.lit(1), "floor": nothing["floor"]}).select(*columns)
    second = _met(dealt, _asked(asking, cells, width, n, between), lambda b, q: b.negatives(q, n_negatives, share), width, n)
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    found = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return positives.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


NEGATIVES_SQL = """
WITH rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
