"""Filter audit against filters applied one after the other, and its diagrams against plain sums."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from oracle import compare, connect

from runledger.llm.audit import AUDIT_SQL, Diagram, filter_audit, order_table, plain_changes
from runledger.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Each order applied to the rows themselves."""
    good, bad = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    first = {}
    for i, t, _, _, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = {}
    for i, t, _, s, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" if len(w) < 50 else ""
        fails += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and first[t] < i else ""
        parts.setdefault(s or "", []).append((fails, i in good, i in bad))
    out = set()
    for part, rows in parts.items():
        removed_in_all, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone, left = [r for r in left if letter in r[0]], [r for r in left if letter not in r[0]]
                removed_in_all[letter] += len(gone)
                total = sum(letter in r[0] for r in rows)
                steps.append((letter, part, "".join(order), step, len(left), len(gone), total - len(gone), sum(r[0] == letter for r in rows),
                              sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out |= {(*s[1:], removed_in_all[s[0]]) for s in steps}
    return out


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes_visit_every_order(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_swaps_keep_the_weights():
    random = np.random.default_rng(1)
    counts = {int(m): (int(random.integers(1, 9)), 1, 0) for m in random.choice(32, 17, replace=False)}
    diagram = Diagram(counts, 5)
    for i in plain_changes(5) * 2:
        diagram.swap(i)
        fresh = Diagram({sum((m >> f & 1) << at for at, f in enumerate(diagram.order)): w for m, w in counts.items()}, 5)
        assert [s[1:] for s in diagram.steps()] == [s[1:] for s in fresh.steps()]
        assert [len(diagram.level(k)) for k in range(5)] == [len(fresh.level(k)) for k in range(5)]  # still reduced
    assert len(order_table({}, "AB")) == 4 and all(r["kept"] == 0 for r in order_table({}, "AB"))


def test_hard_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", words, words, words.upper(), words + " #", "a b " * 40, "# A", "é" * 300, words + "\x1cx\x85y", "x " * 100_000, words]
    docs = [(i // 2 if i % 7 else None, t, "en", [None, "", "s", "t"][i % 4], 1) for i, t in enumerate(texts * 5)]
    docs += [(90, words, "en", "s", 1)] * 4 + [(3, words, "en", "t", 1)]
    labels = [(i, i % 3 == 0 and 1 or None, i % 2) for i in range(20)] + [(None, 1, 1), (4, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id AS part", "text AS mask", "doc_id AS id", "1 AS quality", "text AS docs")
    got = filter_audit(df.repartition(4), spark.createDataFrame(labels, LABELS).selectExpr("*", "doc_id AS text"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, labels)
    assert filter_audit(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    unlabelled = filter_audit(df, spark.createDataFrame([], LABELS)).collect()
    assert {tuple(r) for r in unlabelled} == brute(docs, [])


def test_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES["op11_filter_audit"](spark, sf_dir)
    assert compare(df, connect(sf_dir), AUDIT_SQL) is None
    docs, labels = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()] for t in ("documents", "labels"))
    assert {tuple(r) for r in df.collect()} == brute(docs, labels)
