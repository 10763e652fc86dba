"""The similarity join and its components against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from runledger.llm.components import components
from runledger.llm.jaccard import jaccard_groups, sets_of

SCHEMA = "doc_id long, text string, component_id long"


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, j in {(i, j) for v in by.values() for i in v for j in v if i < j}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near(random, words, k):
    words = list(words)
    for i in random.integers(0, len(words), k):
        words[i] = f"edit{random.integers(1e9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(5)
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    base = [f"w{i % 97}x{i % 13}" for i in range(200)]
    group = [near(random, base, int(random.integers(0, 9))) for _ in range(700)]
    hard = [None, "", " \n", "a", "A", "a b", "b a", "a b c", "A B\tC", "a\x1cb c d", "é É e", "x " * 5000, "x x x", None, "a b c a b c"]
    out = real + [(1000 + i, t) for i, t in enumerate(group)] + [(3000 + i, t) for i, t in enumerate(hard)]
    return out + [(None, "a b c"), (None, "only here with no identifier"), (None, None)] + out[:5]


def test_sets():
    token, bounds = sets_of(["a b c d", None, "a b", "A B", "b c d", "a b c a b c"], 3)
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 1, 3]
    part = [set(token[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert part[2] == part[3] and part[4] < part[0] and len(part[0] & part[5]) == 1


def test_groups_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(d, t, d) for d, t in rows], SCHEMA)
    got = Counter(map(tuple, jaccard_groups(df.repartition(6)).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got if c and 1000 <= c < 2000}) > 3
    for size, percent, counted in ((5, 80, 0.3), (2, 60, 0.1)):
        got = Counter(map(tuple, jaccard_groups(df, size, percent, counted=counted).collect()))
        assert got == brute(rows, size, percent)
    assert jaccard_groups(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(150, 139), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 140), 150]}


def test_near_copies_with_null_and_repeated_identifiers(spark):
    random = np.random.default_rng(11)
    base = [[f"{name}{i}" for i in range(120)] for name in "abcdef"]
    rows = [(None, near(random, base[0], 1)) for _ in range(6)]  # no identifier at all
    rows += [(None, near(random, base[1], 1)) for _ in range(5)] + [(20, near(random, base[1], 1)), (21, near(random, base[1], 1))]
    left, right = base[2][:], base[2][:]
    left[10], right[60] = "left", "right"
    left[90], right[100] = "left2", "right2"
    rows += [(30, " ".join(left)), (None, " ".join(base[2])), (31, " ".join(right))]  # a node without identifier between two
    rows += [(40, near(random, words, 1)) for words in base[3:] for _ in range(4)]  # one identifier, three groups
    rows += [(50 + i, near(random, words, 1)) for i, words in enumerate(base[3:])]
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
