"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each context of 0 to ``ORDER`` bytes.
A byte is coded in the longest context that the tree knows. There it has the probability c / (n + d), where c is
its count, n all counts and d the number of different bytes seen (escape method C). A byte not seen there escapes
with d / (n + d) to the context one byte shorter, in which the bytes of the longer one are excluded; below the
empty context all bytes left are equally likely. So the probabilities of all bytes after a context sum to one, and
minus their binary logarithms are exact code lengths. The statistics are frozen while texts are scored. The
language with the shortest code is predicted.

The trees are fitted on a bounded sample (``SAMPLE_BYTES`` over all languages together): each language gives whole
texts in the order of a hash of the text and its identifier, up to its even share. Grams are counted by Spark; what reaches
the driver and the tasks is at most ``SAMPLE_BYTES * (ORDER + 1)`` counts at any size of the table. Every row is scored
over its whole text. Scoring needs no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import map_batches
from runledger.session import written

ORDER = 4
SAMPLE_BYTES = 4 << 20
BROADCAST_LANGUAGES = 10_000
#: Bytes of text that are scored at a time; longer texts go through in pieces that keep their context.
CHUNK = 2 << 20


def _mask(n: int) -> np.uint64:
    """The lowest ``n`` bytes."""
    return np.uint64((1 << (8 * n)) - 1)


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from place ``order`` on: itself (lowest) and the ``order`` bytes before it as one number."""
    n = len(data) - order
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1):
        out |= data[order - j: order - j + len(out)].astype(np.uint64) << np.uint64(8 * j)
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class ContextTree:
    """Frozen statistics of one language: per order, its grams with counts and its contexts with their sums."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        """``grams[k]``: sorted codes of k context bytes and a byte; ``counts[k]``: how often each occurred."""
        self.grams, self.counts, self.contexts, self.total, self.kinds, self.left = grams, counts, [], [], [], []
        for k, (gram, count) in enumerate(zip(grams, counts)):
            context, start, kinds = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
            self.contexts.append(context)
            self.total.append(np.add.reduceat(count, start))
            self.kinds.append(kinds)
            if not k:
                self.left.append(None)
                continue
            # What is left one order lower when the bytes of a context are excluded: counts, and an escape a new byte.
            shorter = self.counts[k - 1][_find(grams[k - 1], gram & _mask(k))[0]]
            up = _find(self.contexts[k - 1], context & _mask(k - 1))[0]
            self.left.append(self.total[k - 1][up] - np.add.reduceat(shorter, start) + self.kinds[k - 1][up] - kinds)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out, rest = np.zeros(len(codes)), np.arange(len(codes))
        room = np.full(len(codes), -1)  # counts and escapes left after exclusion; -1 before the first known context
        below = np.zeros(len(codes), np.int64)  # bytes excluded
        for k in range(len(self.grams) - 1, -1, -1):
            code = codes[rest]
            at, known = _find(self.contexts[k], (code >> np.uint64(8)) & _mask(k))
            if not known.all():
                unknown, rest, code, at = rest[~known], rest[known], code[known], at[known]
            else:
                unknown = rest[:0]
            first = room[rest] < 0
            space = np.where(first, self.total[k][at] + self.kinds[k][at], room[rest])
            gram, seen = _find(self.grams[k], code & _mask(k + 1))
            hit = rest[seen]
            out[hit] += np.log2(space[seen]) - np.log2(self.counts[k][gram[seen]])
            rest, at, space = rest[~seen], at[~seen], space[~seen]
            escape = self.kinds[k][at] - below[rest]
            open_ = escape > 0  # without new bytes nothing is left here, and the escape is certain
            out[rest[open_]] += np.log2(space[open_]) - np.log2(escape[open_])
            if k:
                room[rest], below[rest] = self.left[k][at], self.kinds[k][at]
            else:
                out[rest] += np.log2(256 - self.kinds[0][at])
            rest = np.concatenate([rest, unknown])
        return out


def _pieces(data: bytes, order: int, chunk: int):
    """A text in pieces, each led by the ``order`` bytes before it (zero bytes at the start)."""
    padded = bytes(order) + data
    for at in range(0, len(data), chunk):
        yield padded[at: at + chunk + order]


def code_lengths(texts: list[bytes], trees: list[ContextTree], order: int = ORDER, chunk: int = CHUNK) -> np.ndarray:
    """Bits of each text (rows) under each tree (columns); equal grams of a chunk are looked up once."""
    out = np.zeros((len(texts), len(trees)))
    rows, parts, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts])
        body = np.ones(len(data), bool)
        starts = np.cumsum(lengths) - lengths
        for j in range(order):
            body[starts + j] = False
        codes = gram_codes(data, order)[body[order:]]
        unique, where = np.unique(codes, return_inverse=True)
        row = np.repeat(np.array(rows), lengths - order)
        for i, tree in enumerate(trees):
            out[:, i] += np.bincount(row, weights=tree.bits(unique)[where], minlength=len(texts))

    for r, text in enumerate(texts):
        for piece in _pieces(text, order, chunk):
            rows.append(r)
            parts.append(piece)
            size += len(piece)
            if size >= chunk:
                flush()
                rows, parts, size = [], [], 0
    if parts:
        flush()
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """A null identifier is read as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _sample(rows: DataFrame, sample_bytes: int) -> DataFrame:
    """lang, text: each language's texts in hash order, as many as fit into its share of ``sample_bytes``."""
    sized = rows.withColumns({"_b": F.octet_length("text"), "_h": F.xxhash64("_id", "text")}).where("_b > 0")
    totals = written(sized.groupBy("lang").agg(F.sum("_b").alias("_all")), "op13-totals")
    n = totals.count()
    share = sample_bytes // max(n, 1)
    # Hash values below twice the share come near it; the running sum then cuts exactly.
    fraction = F.pmod("_h", F.lit(1 << 30)) < F.lit(2 * share) / F.col("_all") * (1 << 30)
    near = sized.join(F.broadcast(totals) if n <= BROADCAST_LANGUAGES else totals, "lang").where(fraction)
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("_sum", F.sum("_b").over(order)).where(F.col("_sum") <= share).select("lang", "text")


def fit_trees(rows: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[ContextTree]]:
    """Languages, by code point, and their trees. ``rows``: _id, lang, text; null languages, null and empty texts teach nothing."""
    sample = written(_sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), sample_bytes), "op13-sample")

    def count(batch: pa.RecordBatch):
        langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
        for lang, text in zip(langs, texts):
            codes = gram_codes(np.frombuffer(bytes(order) + text.encode(), np.uint8), order)
            for k in range(order + 1):
                gram, n = np.unique(codes & _mask(k + 1), return_counts=True)
                yield {"lang": [lang] * len(gram), "k": np.full(len(gram), k), "gram": gram.astype(np.int64), "n": n}

    counted = map_batches(sample, count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow().to_pandas()  # bounded by the sample
    names, trees = sorted(table["lang"].unique()), []
    for lang in names:
        mine = table[table["lang"] == lang]
        grams, counts = [], []
        for k in range(order + 1):
            at = mine[mine["k"] == k].sort_values("gram")
            grams.append(at["gram"].to_numpy().astype(np.uint64))
            counts.append(at["n"].to_numpy())
        trees.append(ContextTree(grams, counts))
    return names, trees


def predicted_languages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits and n_bytes for every row.

    Trained on rows that are not held out (crc32 of the identifier as text, mod 4, is not 2) and have a language.
    score: the probability of the predicted language among all, each as likely before the text was read. bits: the
    shortest code length. Ties go to the smallest language by code point. ``und`` with score 0 and null bits: a null text,
    one without a letter, and all texts where nothing was learned. Repeated rows are rows of their own; a null
    identifier is kept and read as empty text where rows are held out. Other columns are not returned. An empty
    table gives no rows. ``order`` is 6 at most.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out("_id"))
    names, trees = fit_trees(rows.where("NOT held_out").select("_id", "lang", "text"), order, sample_bytes)
    model = df.sparkSession.sparkContext.broadcast(trees)
    ids = f"doc_id {df.schema[id_col].dataType.simpleString()}"

    def score(batch: pa.RecordBatch) -> dict:
        texts, readable = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("letters").to_numpy(zero_copy_only=False)
        out = {"doc_id": batch.column("_id"), "held_out": batch.column("held_out")}
        use = np.flatnonzero(readable) if names else np.zeros(0, int)
        lang, points, bits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        if len(use):
            lengths = code_lengths([texts[i] for i in use], model.value, order)
            best = lengths.argmin(axis=1)
            least = lengths[np.arange(len(use)), best]
            points[use] = 1 / np.exp2(np.maximum(least[:, None] - lengths, -2000)).sum(axis=1)
            for i, b, n in zip(use, best, least):
                lang[i], bits[i] = names[b], float(n)
        return out | {"lang_pred": lang, "score": points, "bits": bits, "n_bytes": [len(t or b"") for t in texts]}

    asked = rows.select("_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return map_batches(asked, score, f"{ids}, held_out boolean, lang_pred string, score double, bits double, n_bytes long")
