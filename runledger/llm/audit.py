"""Filter interaction audit by decision diagrams of failure masks.

A document's failure mask says which filters it fails. For each part of the corpus a diagram holds how many documents
have each mask: a node at a level asks whether the filter of that level passes, equal subdiagrams are one
node, and every node carries the weight (documents, good ones, toxic ones) of all that lies below it. Down the path on
which every filter passes, the weights say what each step of the order keeps, and those of the branches
that leave it what it removes.

Another order is reached by swapping adjacent levels: only the nodes of the two levels change, and a list of all orders in which each
differs from the one before it by one swap (plain changes) visits all of them with one swap each.

Texts are reduced to masks before anything is shuffled. Rows of equal texts are merged into one row a part on the map side, so copies
do not meet in one task, and a part's diagram is built from at most 2^filters masks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import WORD, text_of

NOTHING = 0  # the node without documents, on every level


class Diagram:
    """Documents by failure mask, one filter a level. Nodes are (pass, fail) pairs; level n holds the weights themselves."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int):
        """``counts``: weights by mask; bit i of a mask is set where filter i fails. The first order is 0, 1, ..., n - 1."""
        self.order, self.width = list(range(n)), len(next(iter(counts.values()), (0, 0, 0)))
        self.nodes, self.weights = [None], [(0,) * self.width]
        self.unique: dict[tuple, int] = {}
        self.root = self._build(0, dict(counts))

    def _node(self, level: int, passed: int, failed: int) -> int:
        if passed == failed == NOTHING:
            return NOTHING
        key = (level, passed, failed)
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append((passed, failed))
            self.weights.append(tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed])))
        return self.unique[key]

    def _build(self, level: int, counts: dict[int, tuple[int, ...]]) -> int:
        if not counts:
            return NOTHING
        if level == len(self.order):
            (weight,) = counts.values()
            key = ("weight", weight)
            if any(weight) and key not in self.unique:
                self.unique[key] = len(self.nodes)
                self.nodes.append(None)
                self.weights.append(weight)
            return self.unique.get(key, NOTHING)
        split = [{m: w for m, w in counts.items() if (m >> level) & 1 == side} for side in (0, 1)]
        return self._node(level, *(self._build(level + 1, side) for side in split))

    def level(self, at: int) -> list[int]:
        """Nodes of a level."""
        found = [self.root] if self.root else []
        for _ in range(at):
            found = list(dict.fromkeys(child for node in found for child in self.nodes[node] if child))
        return found

    def swap(self, at: int) -> None:
        """Exchange the filters of levels ``at`` and ``at`` + 1. Nodes above and below stay as they are."""
        nodes = self.level(at)
        for key in [k for k in self.unique if k[0] in (at, at + 1)]:
            del self.unique[key]
        for node in nodes:
            (pp, pf), (fp, ff) = (self.nodes[child] or (NOTHING, NOTHING) for child in self.nodes[node])
            self.nodes[node] = self._node(at + 1, pp, fp), self._node(at + 1, pf, ff)
            self.unique[at, *self.nodes[node]] = node
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight kept, weight removed) for each step of the present order, along the path on which all pass."""
        out, node = [], self.root
        for name in self.order:
            passed, failed = self.nodes[node] if node else (NOTHING, NOTHING)
            out.append((name, self.weights[passed], self.weights[failed]))
            node = passed
        return out


def plain_changes(n: int) -> list[int]:
    """Positions to swap (with the next one) so that all orders of n things are visited, each once."""
    if n < 2:
        return []
    inner, out = plain_changes(n - 1), []
    for i in range(len(inner) + 1):
        # The largest thing runs through the others from one end to the other, then the others change once.
        down = i % 2 == 0
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if i < len(inner):
            out.append(inner[i] + 1 if down else inner[i])
    return out


def order_table(counts: dict[int, tuple[int, int, int]], letters: str) -> list[dict]:
    """One row for each order and step from the (documents, good, toxic) of each failure mask."""
    n = len(letters)
    diagram, changes = Diagram(counts, n), [None, *plain_changes(n)]
    failing = [sum(w[0] for m, w in counts.items() if m >> i & 1) for i in range(n)]
    removed_in_all, alone, rows = [0] * n, [0] * n, []
    for change in changes:
        if change is not None:
            diagram.swap(change)
        name = "".join(letters[i] for i in diagram.order)
        steps = diagram.steps()
        alone[steps[-1][0]] = steps[-1][2][0]  # what the last filter still removes fails it only
        for step, (i, kept, removed) in enumerate(steps, 1):
            removed_in_all[i] += removed[0]
            rows.append({
                "filter_order": name, "step": step, "i": i, "kept": kept[0], "removed": removed[0],
                "redundant": failing[i] - removed[0], "good_lost": removed[1], "toxic_lost": removed[2],
            })
    for row in rows:
        i = row.pop("i")
        row |= {"unique_fails": alone[i], "shapley": removed_in_all[i]}
    return rows


def corpus_filters() -> dict[str, Column]:
    """Failure conditions over ``_text``, ``_words`` and ``_kinds``. E (an earlier equal text) is found by :func:`failure_masks`."""
    text, words = F.col("_text"), F.col("_words")
    return {
        "A": words < 50,
        "B": 100 * F.col("_kinds") < 65 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """part, mask, docs, good, toxic: rows of each failure mask; the bit after those of ``filters`` is an earlier equal text.

    Equal texts have equal masks. Copies are merged by (text, identifier), then by (text, part) with the
    smallest identifier and its rows; of one text only the rows with the smallest identifier of all parts pass.
    """
    word_list = F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("_text"),
    ).withColumn("_list", word_list)
    counted = sized.select("id", "part", "_text", F.size("_list").alias("_words"), F.size(F.array_distinct("_list")).alias("_kinds"))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]).cast("int")
    # Two digests of the text name it: 320 bits, so that different texts do not meet.
    rows = counted.select("id", "part", mask.alias("mask"), F.sha2("_text", 256).alias("text"), F.xxhash64("_text").alias("text2"))
    merged = rows.groupBy("id", "part", "mask", "text", "text2").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality"), F.col("toxic")).where("id IS NOT NULL").groupBy("id").agg(flag("quality"), flag("toxic"))
    # Rows without an identifier have no label; a second key spreads them.
    spread = F.when(F.col("id").isNull(), F.col("text2")).otherwise(F.lit(0))
    known = merged.withColumn("_s", spread).join(marks.withColumn("_s", F.lit(0).cast("long")), ["id", "_s"], "left")
    weighed = known.select(
        "part", "mask", "text", "text2", "id", F.col("n").alias("docs"), (F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    sums = ["docs", "good", "toxic"]
    named = F.col("id").isNotNull()
    texts = weighed.groupBy("text", "text2", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in sums), *(F.coalesce(F.sum(F.when(~named, F.col(c))), F.lit(0).cast("long")).alias(f"nameless_{c}") for c in sums),
        F.min(F.when(named, F.struct("id", *sums))).alias("first"),
    )
    everywhere = F.min("first.id").over(Window.partitionBy("text", "text2"))
    here = F.coalesce(F.col("first.id") == F.col("_least"), F.lit(False))
    passing = {c: F.col(f"nameless_{c}") + F.when(here, F.col(f"first.{c}")).otherwise(F.lit(0)) for c in sums}
    later = F.lit(1 << len(filters)).cast("int")
    both = F.array(
        F.struct(F.col("mask"), *(v.alias(c) for c, v in passing.items())),
        F.struct((F.col("mask") + later).alias("mask"), *((F.col(c) - v).alias(c) for c, v in passing.items())),
    )
    split = texts.withColumn("_least", everywhere).select("part", F.inline(both)).where("docs > 0")
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in sums))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for every
    source and every order of the filters, what each step does.

    ``filters``: failure conditions by letter (:func:`corpus_filters`); ``copies`` names the one for equal texts with a smaller
    doc_id. A null text is empty, a null source the empty string. Rows without a doc_id have no label, are not
    earlier than others, and none is earlier than they. Rows repeated with their doc_id count each. A label
    repeated for a doc_id counts as 1 where any says so; null labels count as 0. Other columns play no part. An empty table gives no rows.
    """
    filters = corpus_filters() if filters is None else filters
    letters = "".join(filters) + copies
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = ", ".join(f"{c} {'string' if c in columns[:2] else 'int' if c == 'step' else 'long'}" for c in columns)

    def audit(masks: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(d), int(g), int(t)) for m, d, g, t in masks[["mask", "docs", "good", "toxic"]].itertuples(index=False)}
        return pd.DataFrame(order_table(counts, letters)).assign(part=masks["part"].iloc[0])[columns]

    return failure_masks(docs, labels, filters).groupBy("part").applyInPandas(audit, schema)


AUDIT_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id AS label_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
failing AS (
    SELECT part, doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
    FROM words),
masks AS (
    SELECT part, ['A', 'B', 'C', 'D', 'E'] AS letters, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM failing LEFT JOIN marks ON doc_id = label_id GROUP BY ALL),
orders AS (
    SELECT '' AS filter_order
    UNION ALL SELECT concat(filter_order, l) FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) x WHERE NOT contains(filter_order, l)),
steps AS (
    SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS letter, string_split(left(filter_order, s - 1), '') AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS s) x WHERE length(filter_order) = 5),
failed AS (SELECT part, n, good, toxic, list_filter(letters, lambda l, i: fails[i]) AS f FROM masks),
counted AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN NOT list_has_any(f, before) AND NOT list_contains(f, letter) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, letter) THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN list_has_any(f, before) AND list_contains(f, letter) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN f = [letter] THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, letter) THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT list_has_any(f, before) AND list_contains(f, letter) THEN toxic ELSE 0 END) AS toxic_lost
    FROM failed, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
