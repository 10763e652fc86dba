"""Quality rules on repetition inside a text, from a suffix array over its words.

Texts are processed in blocks: their words become numbers that differ from text to text, each text ends in a
number of its own (so no suffix compares equal beyond its text), and prefix doubling sorts the suffixes of the whole block at once.
Neighbours in the array give the longest common prefixes. The deepest prefix interval that a suffix lies in
is the larger of the two values beside it, which is therefore the longest repeated substring that starts at
this word; every maximal repeated substring has such a start at each of its places. Their spans are united
by a running sum, which gives the covered fraction, and the largest value is the longest repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from runledger.llm.common import map_batches

BLOCK_CHARS = 4_000_000
SYMBOLS = re.compile(r"[#*$%&|<>]")

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    longest_repeat long, base_failed boolean, kept boolean"""


def repeats(tokens: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and also elsewhere.

    Every text in ``tokens`` ends in a number that occurs once. Each round sorts the suffixes by twice as
    many tokens, and only those that still tie; the ranks of all rounds then give the common prefixes.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rank, minlength=n), out=first[1:])
    rank = first[rank]  # of all suffixes with the same token: the number of smaller ones
    levels, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while True:
        ranks = rank[order]
        same = ranks[1:] == ranks[:-1]
        tied = np.zeros(n, bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        key = rank[who] * (n + 1) + rank[np.minimum(who + step, n - 1)]
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[at] = who
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank = rank.copy()
        rank[who] = at[begin]
        levels.append(rank)
        step *= 2
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        equal = level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
        equal &= (a < n) & (b < n)
        for x in (a, b, common):
            x[equal] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, order[:-1], common)
    np.maximum.at(longest, order[1:], common)
    return longest


def block(words: list[list], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the words covered by repeated substrings of ``least`` words or more; the longest."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.empty(0, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(int(sizes.sum()) + len(words), np.int64)
    word = np.ones(len(tokens), bool)
    word[ends] = False
    distinct = int(codes.max(initial=-1)) + 1
    tokens[word] = codes + distinct * np.repeat(np.arange(len(words)), sizes)  # equal inside one text alone
    tokens[ends] = distinct * len(words) + np.arange(len(words))
    longest = repeats(tokens)
    start = np.flatnonzero(longest >= least)
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + longest[start], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    begins = ends - sizes
    return covered[ends] - covered[begins], np.maximum.reduceat(longest, begins) if len(words) else longest


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


LIMITS = {"least": 8, "max_covered": 0.30, "max_longest": 100, "min_words": 20}


def judged(texts: list[str | None], least: int, max_covered: float, max_longest: int, min_words: int):
    """The columns of ``SCHEMA`` but the identifier, for one block of texts after the other."""
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at] or "")
        while end < len(texts) and chars + len(texts[end] or "") <= BLOCK_CHARS:
            chars += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        words = [t.encode().split() for t in part]  # bytes are split at ASCII white space alone
        covered, longest = block(words, least)
        n = np.array([len(w) for w in words], np.int64)
        failed = (n < min_words) | (covered > max_covered * n)
        yield {
            "n_words": n, "word_chars": [len(t) - sum(map(t.count, " \t\n\v\f\r")) for t in part],
            "n_symbols": [len(SYMBOLS.findall(t)) for t in part], "n_dup_lines": [dup_lines(t) for t in part],
            "n_repeat_words": covered, "longest_repeat": longest, "base_failed": failed, "kept": ~failed & (longest <= max_longest),
        }
        at = end


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``df`` (see ``SCHEMA``), for every whole text; ``limits`` as in ``LIMITS``.

    n_repeat_words: words inside repeated substrings of ``least`` words or more, first places included.
    base_failed: fewer than ``min_words`` words, or more than ``max_covered`` of them repeated. kept: not
    base_failed, and no repeat longer than ``max_longest`` words. Null and empty texts have no words and
    fail. Rows with a null identifier and repeated rows are judged like any other; an empty table gives no
    rows; other columns of ``df`` are not returned. A text of any length is one block of its own; shorter
    ones share blocks of about ``BLOCK_CHARS`` characters.
    """

    def make(batch):
        ids, at = batch.column(0).to_pylist(), 0
        for columns in judged(batch.column(1).to_pylist(), **LIMITS | limits):
            yield columns | {"doc_id": ids[at:at + len(columns["kept"])]}
            at += len(columns["kept"])

    return map_batches(df.select(id_col, text_col), make, SCHEMA)


def kept_rows(df: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The whole rows of ``df`` whose texts the rules keep. A row is judged where it is read, nothing is joined."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            kept = [c["kept"] for c in judged(texts, **LIMITS | limits)]
            yield batch.filter(pa.array(np.concatenate([np.empty(0, bool), *kept])))

    return df.mapInArrow(run, df.schema)
