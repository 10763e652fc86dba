"""Data-parallel fitting: splits, shards, batches, linear and softmax models, meters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.names import _col
from runledger.operators.series import Series


def is_training(key: Column | str, test_share: float = 0.25) -> Column:
    """Repeatable split: True for the training share of keys."""
    return F.pmod(_col(key), F.lit(100)) >= round(test_share * 100)


def linear_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of least squares in one mergeable aggregate."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def absolute_error(rows: DataFrame, fit: DataFrame, x: str, y: str) -> DataFrame:
    """Mean absolute error of a one-row fit; its two numbers reach the rows as scalars."""
    guess = fit.select("slope").scalar() * F.col(x) + fit.select("intercept").scalar()
    return rows.select(F.abs(F.col(y) - guess).alias("_e")).agg(F.avg("_e").alias("mae"))


def scaled(vector: Column | str, mean: float, std: float) -> Column:
    return F.transform(_col(vector), lambda v: (v.cast("double") - mean) / std)


def shard_of(rows: DataFrame, order: list[str], world: int, hot: bool | None = None) -> DataFrame:
    """Row i goes to rank i mod world."""
    out = Series(rows, [], order, hot).row_number("_n").df
    return out.withColumn("rank", ((F.col("_n") - 1) % world).cast("int")).drop("_n")


def batch_of(
    rows: DataFrame, order: list[str], per_worker: int, workers: int, step_budget: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Step number of each row, a step taking ``per_worker`` rows of every worker, and whether it runs.

    ``step_budget`` is the total number of steps, shared out among the workers; later steps
    do not run.
    """
    out = Series(rows, [], order, hot).row_number("_n").df
    step = F.floor((F.col("_n") - 1) / (per_worker * workers))
    out = out.withColumn("step", step.cast("long")).drop("_n")
    runs = F.lit(True) if step_budget is None else F.col("step") < step_budget // workers
    return out.withColumn("runs", runs)


def mean_gradient(rows: DataFrame, shard: Column, x: str, y: str, slope: float, intercept: float) -> DataFrame:
    """Squared-error gradient, averaged within each shard and then over shards, unweighted."""
    off = F.lit(slope) * F.col(x) + F.lit(intercept) - F.col(y)
    per_shard = rows.groupBy(shard.alias("shard")).agg(
        F.avg(2 * off * F.col(x)).alias("g_slope"), F.avg(2 * off).alias("g_intercept")
    )
    return per_shard.agg(
        F.avg("g_slope").alias("g_slope"), F.avg("g_intercept").alias("g_intercept"),
        F.count(F.lit(1)).alias("shards"),
    )


def weighted_mean(value: Column | str, n: Column | str) -> Column:
    """Aggregate: sum of value times n over sum of n."""
    return F.try_divide(F.sum(_col(value) * _col(n)), F.sum(_col(n)))


def is_hit(scores: Column | str, label: Column | str) -> Column:
    """Is the first greatest score that of the label (0-based)."""
    s = _col(scores)
    return F.array_position(s, F.array_max(s)) - 1 == _col(label)


def accuracy(scores: Column | str, label: Column | str) -> Column:
    return F.avg(is_hit(scores, label).cast("int"))


def cross_entropy(scores: Column | str, label: Column | str) -> Column:
    s = F.transform(_col(scores), lambda v: v.cast("double"))
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v))
    return F.log(total) - F.get(s, _col(label))


def epoch_table(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """Loss and accuracy per epoch, training and test side by side.

    ``rows``: epoch, is_test, scores, label.
    """
    test = F.col("is_test")
    loss, hit = cross_entropy(scores, "label"), is_hit(scores, "label").cast("double")
    mean = lambda v, when: F.avg(F.when(when, v))
    return rows.groupBy("epoch").agg(
        mean(loss, ~test).alias("train_loss"), mean(hit, ~test).alias("train_acc"),
        mean(loss, test).alias("test_loss"), mean(hit, test).alias("test_acc"),
    )


def softmax_fit(rows: DataFrame, features: str, label: str, steps: int = 40, penalty: float = 0.01):
    """Multinomial logistic regression on an array column; a fitted MLlib model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=steps, regParam=penalty).fit(data)


def softmax_score(model, rows: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(features))))
    return scored.withColumn("predicted", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


#: Bytes of a message among the members of a gang, all of which pass through the driver.
MESSAGE = 1 << 20


def descent_fit(
    rows: DataFrame, features: str, label: str, key: str, classes: int, members: int, batch: int = 256,
    epochs: int = 1, rate: float = 0.5, penalty: float = 0.0,
):
    """Weights (one row a class, the last column the intercepts) of a softmax classifier, trained by a gang of members.

    Rows are dealt to the members by a hash of ``key`` and taken in its order. In each step every member takes its next
    ``batch`` rows, and all move by the mean of their gradients, unweighted; a member without rows left has no part in
    the mean. An epoch is one pass over the rows, which stream by, and one barrier stage. A lost member starts the epoch
    anew with the same weights.

    A call among the members takes a second, however short its messages. So they gather batches from one another, as many
    as ``MESSAGE`` bytes hold, and each works out the steps of these, which are the same for all; of batches so large that
    a message holds one, they gather the gradients. What is held is a message of each member and the weights.
    """
    import base64
    from itertools import islice

    import numpy as np
    import pandas as pd

    data = rows.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    data = data.where("x IS NOT NULL AND y IS NOT NULL").repartition(members, "key").sortWithinPartitions("key", "y")
    width = rows.agg(F.max(F.size(features))).first()[0]
    weights = np.zeros((classes, (width or 0) + 1))
    if width is None:
        return weights

    ahead = max(1, MESSAGE // (8 * batch * (width + 2)))

    def epoch(start):
        def member(frames):
            from pyspark import BarrierTaskContext

            gang, w, steps = BarrierTaskContext.get(), start.copy(), 0
            batches = batches_of(frames, batch)
            gather = lambda block: [
                np.frombuffer(base64.b64decode(m)) for m in gang.allGather("" if block is None else base64.b64encode(block.tobytes()).decode())
            ]
            while True:
                taken = list(islice(batches, ahead))
                if ahead > 1:
                    rows = [np.hstack([x, y[:, None]]) for x, y in taken]
                    theirs = [b.reshape(-1, width + 2) for b in gather(np.vstack(rows) if rows else None)]
                    of = lambda b, i: b[i * batch : (i + 1) * batch]
                    moves = lambda: (
                        [gradient(w, np.ascontiguousarray(x[:, :-1]), x[:, -1].astype(int), penalty) for b in theirs if len(x := of(b, i))]
                        for i in range(ahead)
                    )
                else:
                    mine = gradient(w, *taken[0], penalty) if taken else None
                    gathered = [g.reshape(w.shape) for g in gather(mine) if len(g)]
                    moves = lambda: iter([gathered])
                before = steps
                for each in moves():
                    if each:
                        w, steps = w - rate * sum(each) / len(each), steps + 1
                if steps == before:
                    break
            yield pd.DataFrame({"rank": [gang.partitionId()], "steps": [steps], "weights": [w.ravel()]})
        return member

    for _ in range(epochs):
        ran = data.mapInPandas(epoch(weights), "rank int, steps long, weights array<double>", barrier=True)
        weights = np.array(ran.where("rank = 0").collect()[0]["weights"]).reshape(classes, width + 1)
    return weights


def batches_of(frames, size: int):
    """(features with a one at the end, labels) of ``size`` rows each, the last one of those that are left."""
    import pandas as pd

    left = None
    for f in frames:
        left = f if left is None else pd.concat([left, f])
        while len(left) >= size:
            yield _matrix(left.iloc[:size])
            left = left.iloc[size:]
    if left is not None and len(left):
        yield _matrix(left)


def _matrix(frame):
    import numpy as np

    x = np.array(frame["x"].tolist(), float)
    return np.hstack([x, np.ones((len(x), 1))]), frame["y"].to_numpy()


def gradient(weights, x, y, penalty: float):
    """Of the mean cross-entropy of a batch, with a penalty on all weights but intercepts."""
    import numpy as np

    score = x @ weights.T
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    slope = penalty * weights
    slope[:, -1] = 0
    return p.T @ x / len(y) + slope


def linear_predicted(rows: DataFrame, features: str, weights) -> DataFrame:
    """``predicted``: the class with the largest score, the first of equal ones."""
    v = F.col(features).cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(v, F.array(*(F.lit(float(c)) for c in w[:-1])), lambda a, b: a * b), F.lit(float(w[-1])), lambda s, z: s + z)
    scores = F.array(*(dot(w) for w in weights))
    return rows.withColumn("predicted", (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
