"""Mixing against SQL, packing against the tokenizer and the bound."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runledger.llm.mixing import MIX_SQL, mixed, mixed_documents
from runledger.llm.packing import nnls, packed, pieces, plan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    hard = [None, "", " \t\n", "a", "a b c " * 900, "x\ty\n\n z  q r", "it's  DON'T 12345 ٣ ½\x1c!\x1c?\r\n  end ", "\U0001f600 ok <|endoftext|> é", "b" * 20000]
    rows = [(10_000 + i if i else None, t, None, "ä" if i % 2 else None, None) for i, t in enumerate(hard * 2)]
    return spark.read.parquet(SF).unionByName(spark.createDataFrame(rows, SCHEMA)).cache()


def test_mix_equals_sql(docs):
    real = docs.where("doc_id < 10000")
    got = Counter(tuple(r) for r in mixed(real, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken").collect())
    documents = real.toPandas()  # noqa: F841
    want = Counter(duckdb.sql(MIX_SQL).fetchall())
    assert got == want


def test_rows_without_an_identifier_share_out_over_slices(spark, monkeypatch):
    rows = [(None if i % 2 else 5, f"text {i} of no name", None, "a" if i < 900 else "b", None) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixed(df, ["source", "text"])
    want = Counter(tuple(r) for r in got.select("source", "text", "taken", "before").collect())
    ends = got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(r["sum(taken)"] == np.floor(r["max(target)"]) for r in ends) and len(want) == 1200
    monkeypatch.setattr("runledger.llm.mixing.SLICE_ROWS", 0.01)
    assert Counter(tuple(r) for r in mixed(df.repartition(3), ["source", "text"]).select("source", "text", "taken", "before").collect()) == want


def test_mix_targets(docs):
    got = mixed(docs, ["doc_id", "source"]).toPandas()
    assert len(got) == docs.count() and got.loc[got["size"] == 0, "taken"].eq(0).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (by.taken == np.floor(by.target)).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 * by["size"].sum() and (got.taken <= 3 * got["size"]).all()
    weights = [1 + i % 3 for i in range(len(by))]
    by = by.sort_index(na_position="last")
    free = by.target < 3 * by.source_size - 1e-9
    level = (by.target / weights)[free]
    assert free.any() and level.max() - level.min() < 1e-6 * level.max() and ((by.target / weights)[~free] <= level.max() + 1e-6).all()
    assert mixed(docs.limit(0), ["doc_id"]).count() == 0
    again = mixed(docs.repartition(5), ["doc_id", "source"]).toPandas()
    key = ["doc_id", "size", "taken"]
    assert Counter(map(tuple, got[key].fillna(-1).values)) == Counter(map(tuple, again[key].fillna(-1).values))


def test_mixed_documents(docs):
    found = mixed_documents(docs)
    assert found.columns == docs.columns
    taken = {(r.doc_id, r.source): r for r in mixed(docs.where("doc_id < 10000"), ["doc_id", "source"]).collect()}
    copies = Counter((r.doc_id, r.source) for r in mixed_documents(docs.where("doc_id < 10000")).collect())
    size, target = defaultdict(int), {}
    for key, r in taken.items():
        assert copies[key] <= 3 and abs(copies[key] * r["size"] - r.taken) <= r["size"] / 2 + 1
        size[key[1]] += copies[key] * r["size"]
        target[key[1]] = r.target
    assert all(abs(size[s] - target[s]) <= max(r["size"] for k, r in taken.items() if k[1] == s) for s in target)


def test_pieces_are_the_tokenizer_s(docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = defaultdict(list)
    for r in pieces(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True).collect():
        rows[r.doc_id].append(r)
    for d in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        got = sorted(rows.pop(d.doc_id), key=lambda r: r.piece)
        want = own.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(r.ids for r in got), "<u4").tolist() == want
        assert [r.start for r in got] == [sum(x.length for x in got[:i]) for i in range(len(got))]
        assert [r.piece for r in got] == list(range(len(got))) and all(r.length == 2048 for r in got[1:])
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) <= 4 * 2048 for r in got)
    assert not rows


def test_sequences_are_gapless_and_few(docs):
    found = packed(docs).collect()
    cut = pieces(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == Counter(map(tuple, cut))
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(r.length for r in found) // 2048) + 1
    assert packed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    random = np.random.default_rng(seed)
    lengths = np.clip(random.lognormal(*[(5, 1), (6, 0.5), (3, 2), (7, 0.1), (1, 0.5), (7.5, 1)][seed], 5000), 1, 2048).astype(int)
    histogram = Counter(lengths.tolist())
    runs, used = plan(histogram), Counter()
    for part, n in runs:
        assert n > 0 and sum(part) <= 2048
        for length in part:
            used[length] += n
    assert used == histogram
    assert sum(n for _, n in runs) <= 1.01 * max(-(-lengths.sum() // 2048), (lengths > 1024).sum()) + 1


def test_nnls():
    random = np.random.default_rng(1)
    a, x = random.random((30, 12)), np.maximum(random.normal(size=12), 0)
    assert np.allclose(nnls(a, a @ x), x, atol=1e-6)
