"""N-gram Jaccard join by prefixes under several global token orders.

A text's set holds 64-bit hashes of its shingles; texts with equal sets are one node. Two sets of similarity
``threshold`` share a token of their prefixes (a tenth of the set at 0.9) under every global order of tokens.

The first order is by frequency, rare tokens first. To count less, it puts the tokens of a fixed part of the
hash space (a fifth, for 0.9) before all others and sorts only those by the number of texts that hold them; a set
that has too few of them goes on in the order of the hashes. Tokens of one text alone need no partner: they only fill its
prefix, so most texts are done here. The other orders are by hashes of their own.

Nodes that share a prefix token under the first order meet as follows. Each node belongs to a block of about
``BLOCK`` nodes, chosen so that nodes which share tokens with the same smallest node lie together; for a token,
every node goes to the pairs of its block with the other blocks that hold the token. Hence a group of k
near copies costs k * k / BLOCK rows and no pair is ever a row. Inside a pair of blocks the prefixes under the
other orders are intersected, what remains is verified on the whole sets, and a spanning forest of the
links is returned. Components of all links are then found by stars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import map_batches
from runledger.llm.components import components
from runledger.session import written

BLOCK = 256
ORDERS = 2  # by hashes, besides the one by frequency
BLOCK_CHARS = 4_000_000
BATCH = 2_048  # rows of pairs of blocks that are verified in one go
MATRIX = 4_000_000  # numbers in a slice of the token matrix of two blocks

GROWTH = np.uint64(0x9E3779B97F4A7C15)
STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * STEPS[1]
    return x ^ (x >> np.uint64(31))


def sets_of(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, those of a text sorted and distinct, and the bounds of each text's part.

    Shingles of ``size`` words in lower-case A-Z; a text with fewer words is one token, one without any has none.
    """
    words = [(t or "").encode().lower().split() for t in texts]  # of bytes: ASCII letters and white space alone
    n = np.array([len(w) for w in words], np.int64)
    code: dict[bytes, int] = {}
    flat = np.array([code.setdefault(x, len(code)) for w in words for x in w], np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in code], np.uint64)
    h = np.concatenate([hashes[flat] if len(flat) else np.empty(0, np.uint64), np.zeros(size, np.uint64)])
    total, own = len(flat), np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(total)  # words from here to the end of the text
    used = np.minimum(left, size)
    token = np.zeros(total, np.uint64)
    for k in range(size):
        token = np.where(k < used, mixed(token * GROWTH + h[k:k + total]), token)
    token = mixed(token + used.astype(np.uint64))
    whole = (left >= size) | ((np.repeat(n, n) < size) & (left == np.repeat(n, n)))
    token, own = token[whole], own[whole]
    by = np.lexsort((token, own))
    token, own = token[by], own[by]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return token[new], np.searchsorted(own[new], np.arange(len(texts) + 1))


def blocks_of(ids: list, texts: list, most: int = BLOCK_CHARS):
    """Neighbouring texts of ``most`` characters together, or one longer text alone."""
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at] or "")
        while end < len(texts) and chars + len(texts[end] or "") <= most:
            chars += len(texts[end] or "")
            end += 1
        yield ids[at:end], texts[at:end]
        at = end


def node_of(token: np.ndarray) -> int:
    """A name for a set that only equal sets share."""
    return xxhash.xxh3_64_intdigest(token.tobytes()) - (1 << 63)


def order_keys(token: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens in one of the global orders by hash."""
    return mixed(token * STEPS[2] + np.uint64(int(STEPS[3]) * (order + 1) % (1 << 64)))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (-(-n * percent // 100)) + 1, 0)


def prefixes(token, bounds, order, percent):
    """Places in ``token`` of the prefixes of all sets, and the bounds of each set's part."""
    n = np.diff(bounds)
    own = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((order_keys(token, order), own))
    size = prefix_sizes(n, percent)
    inside = np.arange(len(token)) - np.repeat(bounds[:-1], n)
    return by[inside < np.repeat(size, n)], np.concatenate([[0], np.cumsum(size)])


def candidates(token: np.ndarray, bounds: np.ndarray, percent: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all sets that may lie in a prefix of the first order, set by set; bounds; which are uncounted.

    All tokens of the counted part of the hash space (the smallest hashes), and as many more as the prefix lacks.
    """
    n = np.diff(bounds)
    inside = np.arange(len(token)) - np.repeat(bounds[:-1], n)  # tokens of a set are sorted
    first = token < np.uint64(int(share * (1 << 64)))
    many = np.add.reduceat(np.append(first, False), bounds[:-1]) * (n > 0) if len(n) else n
    keep = inside < np.repeat(np.maximum(many, prefix_sizes(n, percent)), n)
    return token[keep], np.concatenate([[0], np.cumsum(np.maximum(many, prefix_sizes(n, percent)))]), ~first[keep]


def shared(rows: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of ``rows`` (distinct tokens each) have in common."""
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), len(rows)), np.float32)
    flat, own = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
    value, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    own, column = own[keep], np.unique(column[keep], return_inverse=True)[1] if keep.any() else column[keep]
    by = np.argsort(column, kind="stable")
    own, column = own[by], column[by]
    columns = int(column.max(initial=-1)) + 1
    step = min(columns, max(1, MATRIX // len(rows)))
    for first in range(0, columns, max(step, 1)):
        at, to = np.searchsorted(column, [first, first + step])
        part = np.zeros((len(rows), step), np.float32)
        part[own[at:to], column[at:to] - first] = 1
        out += part @ part.T
    return out


def links_in(names: np.ndarray, side: np.ndarray, sets: list[np.ndarray], heads: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes of two blocks (``side`` 0 and 1), or inside one.

    ``heads``: for each order, the prefixes of the sets.
    """
    n = np.array([len(s) for s in sets], np.int64)
    likely = np.triu(np.ones((len(n), len(n)), bool), 1)
    if side.any():
        likely &= side[:, None] != side[None, :]
    likely &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
    for head in heads:
        if not likely.any():
            return []
        likely &= shared(head) > 0
    some = np.flatnonzero(likely.any(axis=0) | likely.any(axis=1))
    if not len(some):
        return []
    both = shared([sets[i] for i in some])
    links = likely[np.ix_(some, some)] & (100 * both >= percent * (n[some][:, None] + n[some] - both))
    root, forest = list(range(len(some))), []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(*np.nonzero(links)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            forest.append((int(names[some[i]]), int(names[some[j]])))
    return forest


def jaccard_groups(df: DataFrame, size: int = 3, percent: int = 90, orders: int = ORDERS, counted: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``df``.

    ``counted``: the part of the hash space whose tokens are counted; of use above 1 - percent / 100, and right
    for any value. Two texts link when 100 * common shingles >= percent * shingles of both together; component_id is the
    smallest doc_id that can be reached by links, itself included. Null and empty texts have no shingles and
    link with nothing: each such row is a component of its own. Rows with a null identifier link like others and
    get the smallest identifier of their component, null if it has none; repeated rows are copies. An empty
    table gives no rows. Columns other than doc_id and text are not returned.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))  # a name of the text too where doc_id is null or repeated

    def describe(batch):
        ids_in, texts_in, rows_in = (batch.column(c).to_pylist() for c in range(3))
        for both, texts in blocks_of(list(zip(ids_in, rows_in)), texts_in):
            ids, rows = map(list, zip(*both))
            token, bounds = sets_of(texts, size)
            some, ends, late = candidates(token, bounds, percent, counted)
            some = some.view(np.int64)
            yield {
                "doc_id": ids, "row": rows, "n": np.diff(bounds), "x": [node_of(token[a:b]) for a, b in zip(bounds, bounds[1:])],
                "tokens": [some[a:b] for a, b in zip(ends, ends[1:])], "late": [int(late[a:b].sum()) for a, b in zip(ends, ends[1:])],
            }

    nodes = written(map_batches(docs, describe, "doc_id long, row long, n long, x long, tokens array<long>, late long"), "op6-nodes")
    token = nodes.where("n > 0").select("x", "n", (F.size("tokens") - F.col("late")).alias("early"), F.posexplode("tokens").alias("at", "t"))
    often = token.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")  # texts, copies included
    token = token.join(often, "t").groupBy("x", "t").agg(*(F.first(c).alias(c) for c in ("n", "early", "at", "c")))
    late, in_set = F.col("at") >= F.col("early"), Window.partitionBy("x")
    place = F.row_number().over(in_set.orderBy(late, "c", "t")) + F.col("early") - F.sum((~late).cast("long")).over(in_set)
    token = token.withColumn("place", place).where(late | (F.col("place") <= F.expr(f"n - (n * {percent} + 99) div 100 + 1"))).select("t", "x", "n")
    token = written(token, "op6-prefixes")
    again = token.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least")).where("c > 1").select("t", "least")
    token = written(token.join(again, "t"), "op6-tokens")
    group = token.groupBy("x").agg(F.min("least").alias("g"))
    sizes = group.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    block = group.join(sizes, "g").select("x", F.xxhash64("g", F.pmod(F.xxhash64("x"), "parts")).alias("b"))
    token = written(token.join(block, "x").select("t", "x", "n", "b"), "op6-blocks")
    held = token.groupBy("t", F.col("b").alias("other")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("c"))
    sides = token.join(held, "t").where(
        f"(b <> other or c > 1) and 100 * n >= {percent} * low and 100 * high >= {percent} * n"
    ).select(F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "x", (F.col("b") > F.col("other")).alias("side"))
    sides = written(sides.distinct(), "op6-sides")
    wanted = sides.groupBy("x").agg(F.lit(1).alias("_")).select("x")
    sample = nodes.where("n > 0").groupBy("x").agg(F.min("row").alias("row")).join(wanted, "x")
    texts = docs.select("row", "text").join(sample, "row").dropDuplicates(["x"]).select("x", "text")

    def verify(frame):
        x, first, at = np.unique(frame["x"].to_numpy(), return_index=True, return_inverse=True)
        token, bounds = sets_of(frame["text"].iloc[first].tolist(), size)
        cut = lambda values, ends: [values[a:b] for a, b in zip(ends, ends[1:])]
        sets, heads = cut(token, bounds), []
        for order in range(orders):
            places, ends = prefixes(token, bounds, order, percent)
            heads.append(cut(token[places], ends))
        lo, hi, side = (frame[c].to_numpy() for c in ("lo", "hi", "side"))
        by = np.lexsort((at, hi, lo))
        edges = np.flatnonzero((np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)) + 1
        found = []
        for unit in np.split(by, edges):
            own = at[unit]
            found += links_in(x[own], side[unit], [sets[i] for i in own], [[h[i] for i in own] for h in heads], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    batches = max(1, -(-sides.count() // BATCH))
    units = sides.withColumn("batch", F.pmod(F.xxhash64("lo", "hi"), F.lit(batches)))
    links = units.join(texts, "x").groupBy("batch").applyInPandas(verify, "a long, b long")
    roots = components(links).withColumnRenamed("node", "x")
    grouped = nodes.select("doc_id", "n", F.when(F.col("n") > 0, F.col("x")).alias("x")).join(roots, "x", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "x"))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, **how) -> DataFrame:
    """``df`` with one row of each group of near copies: of those with the smallest doc_id (null last), any.

    Rows are told apart by doc_id and text together, so repeated rows, rows with a null doc_id and different
    texts under one doc_id are all judged for what they are.
    """
    rows = df.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = jaccard_groups(rows.select(F.col("_row").alias("doc_id"), "text"), **how).select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))
    best = rows.select("doc_id", "_row").join(groups, "_row").groupBy("_group").agg(first["_row"].alias("_row")).select("_row")
    return rows.join(best, "_row", "left_semi").dropDuplicates(["_row"]).select(*df.columns)
