"""Language identification against a plain PPM coder, and its accuracy on rows held out."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runledger.llm.ppm import ContextTree, code_lengths, gram_codes, predicted_languages

SCHEMA = "doc_id long, text string, lang string"


class Plain:
    """PPM with method C and exclusion, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            t = bytes(order) + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.seen[t[i - k:i]][t[i]] += 1

    def probability(self, context, symbol):
        p, out = 1.0, set()
        for k in range(self.order, -1, -1):
            c = context[len(context) - k:]
            if c not in self.seen:
                continue
            left = {s: n for s, n in self.seen[c].items() if s not in out}
            if not left:
                continue
            if symbol in left:
                return p * left[symbol] / (sum(left.values()) + len(left))
            p *= len(left) / (sum(left.values()) + len(left))
            out |= set(left)
        return p / (256 - len(out))

    def bits(self, text):
        t = bytes(self.order) + text
        return -sum(math.log2(self.probability(t[i - self.order:i], t[i])) for i in range(self.order, len(t)))


def tree_of(texts, order):
    codes = np.concatenate([gram_codes(np.frombuffer(bytes(order) + t, np.uint8), order) for t in texts])
    both = [np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(order + 1)]
    return ContextTree([g for g, _ in both], [n for _, n in both])


@pytest.mark.parametrize("order", [0, 1, 3, 4, 6])
def test_code_lengths(order):
    random = np.random.default_rng(order)
    train = [b"abracadabra abra", b"", b"x", "Straße, été".encode(), bytes(random.integers(97, 100, 300).astype(np.uint8))]
    other = [b"the cat", bytes(range(256))]
    texts = [b"", b"a", b"abracadabra", "été zebra \x00".encode(), b"abab" * 50, bytes(random.integers(0, 256, 99).astype(np.uint8))]
    plain, trees = [Plain(t, order) for t in (train, other)], [tree_of(t, order) for t in (train, other)]
    want = np.array([[p.bits(t) for p in plain] for t in texts])
    assert np.allclose(code_lengths(texts, trees, order), want)
    assert np.allclose(code_lengths(texts, trees, order, chunk=7), want)  # texts in pieces


def test_probabilities_sum_to_one():
    tree = tree_of([b"abracadabra", b"bananarama"], 3)
    for context in (b"abr", b"xyz", b"ana", b"\0\0\0", b"zza"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs(np.exp2(-tree.bits(codes)).sum() - 1) < 1e-9


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    hard = [(5001, None, "en"), (5002, "", "en"), (5003, " 12 ²#\n", "de"), (5004, "x", None), (5005, "é" * 200_000, "fr"), (None, "the house is old", "en"),
            (5006, "das Haus und die Katze " * 9000, None), (5007, None, None)]
    rows = real + hard + real[:3]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id AS held_out", "doc_id AS score", "text AS _id")
    got = predicted_languages(df.repartition(5))
    out = got.collect()
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in rows)
    truth = {i: (t, g) for i, t, g in rows}
    right = n = 0
    for r in out:
        text, lang = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert r.n_bytes == len((text or "").encode()) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_²]", text or "")) == (r.bits is None)
        if r.held_out and lang and r.lang_pred != "und":
            n, right = n + 1, right + (r.lang_pred == lang)
    assert n > 200 and right >= 0.99 * n, (right, n)
    by = {r.doc_id: r for r in out}
    assert by[5006].lang_pred == "de" and by[5002].score == 0
    # lang and source of the row scored play no part, and the order of rows neither.
    assert rows_of(predicted_languages(df.repartition(3))) == rows_of(got)


def test_bounded_sample(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = predicted_languages(table, sample_bytes=400_000).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count()


def test_empty_and_unlearned(spark):
    assert predicted_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    out = predicted_languages(spark.createDataFrame([(1, "some words", None), (2, None, "en")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score, r.bits) for r in out] == [("und", 0.0, None)] * 2
    tie = spark.createDataFrame([(1, "aa bb", "y"), (2, "aa bb", "x"), (3, "bb", None)], SCHEMA)
    assert {r.lang_pred for r in predicted_languages(tie).collect()} == {"x"}
