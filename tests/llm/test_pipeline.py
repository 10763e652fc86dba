"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from runledger.llm.pii import find_pii

from .test_jaccard import brute, shingles
from .test_texts import brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long"


@pytest.fixture(scope="module")
def steps(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(*r, None, 1) for r in real]
    long = " ".join(f"own{i}" for i in range(60))
    rows += [(None, None, None, None, None, None, 1), (None, long, "en", None, 3, True, 2), (None, long, "en", None, 3, True, 2), (7001, long + " end", "en", "src0", 3, True, 2)]
    rows += [(8000, "mail me@host.example.com " + long.replace("own", "other"), "en", "zz", 3, False, 2)] + rows[:9]
    out = [spark.createDataFrame(rows, SCHEMA).repartition(4).cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "").cache())
    return out


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "pii", "mixing", "packing"]
    assert all(s.schema.simpleString() == steps[0].schema.simpleString() for s in steps[1:5])


def test_quality(steps):
    want = Counter()
    for r, n in bag(steps[0]).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        if len(words) <= 1500:
            covered, longest = brute_repeats(words)
            if len(words) >= 20 and 100 * covered <= 30 * len(words) and longest <= 100:
                want[r] += n
        elif r in bag(steps[1]):
            want[r] += n
    assert bag(steps[1]) == want


def test_near_copies(steps):
    before = steps[1].select("doc_id", "text").collect()
    groups = brute([(i, t) for i, (_, t) in enumerate(before)], 5, 80)
    least = {}
    for i, _, g in groups:
        d = before[i].doc_id
        least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
    got = steps[2].collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(least.values())
    assert bag(steps[2]) - bag(steps[1]) == Counter() and all(shingles(r.text) for r in got)


def test_pii(steps):
    before, after = steps[2].collect(), {r.doc_id: r for r in steps[3].collect()}
    assert len(before) == len(after)
    spans = {r.doc_id: r.spans for r in find_pii(steps[2]).collect()}
    assert any(spans.values()) and "me@host" not in after[8000].text and "<email>" in after[8000].text
    for r in before:
        if not spans[r.doc_id]:
            assert after[r.doc_id].text == r.text
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
    assert not any(r.spans for r in find_pii(steps[3]).collect())


def test_mixing(steps):
    copies = bag(steps[4])
    assert set(copies) <= set(bag(steps[3])) and max(copies.values()) <= 3
    words = lambda rows: sum(n * len(r[1].split()) for r, n in rows.items())
    assert abs(words(copies) - words(bag(steps[3]))) < 0.05 * words(copies)


def test_packing(spark, steps):
    rows = steps[5].collect()
    assert Counter((r.doc_id, r.piece) for r in rows if r.piece == 0) == Counter((r[0], 0) for r in bag(steps[4]).elements())
    total = Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and len(total) <= 1.02 * sum(total.values()) / 2048 + 2
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == steps[5].columns
