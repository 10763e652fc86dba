"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths.

Texts are tokenised once; longer ones are cut into pieces of ``capacity`` tokens. All that the plan needs is
the histogram of piece lengths (at most ``capacity`` numbers). Patterns of up to three lengths that fill a
sequence are enumerated over 128 classes of lengths, non-negative least squares fit their repeat counts to the
histogram, and the rounded counts take pieces class by class, the last of a pattern by best fit. Gaps that stay
are filled with the longest residual pieces that fit, and the other residual pieces are packed by best fit,
longest first. A plan is a list of runs (lengths, repeats), so its size depends on the lengths and not on the
number of texts. Pieces are then numbered inside their length, and the number falls into one interval of the
plan.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_batches, numbered
from runledger.session import written

CAPACITY = 2048
CLASSES = 128
END = bytes(4)  # id 0
CACHED = 1_000_000

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")


class Tokens:
    """Texts to little-endian 32-bit ids of the byte-level vocabulary in ``path``.

    Ids are found once for each run of blanks with the word after it. No token crosses the start of
    such a run, so joining them gives the ids of the whole text. Texts with other white space are not split.
    ``added``: texts that are one id wherever they stand; a text is cut at them, the leftmost and longest first.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {text: np.array([one], "<u4").tobytes() for text, one in (added or {}).items()}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.cut.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return self.ids(text)
        known, chunks = self.known, CHUNK.findall(text)
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = self.ids(c)
            return b"".join([known[c] for c in chunks])


def pieces(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every whole text, id 0 at its end.

    Texts longer than ``capacity`` are cut so that all pieces but the first are full.
    """
    import public_tokenizers

    path, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    added = None
    if not vocabulary:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    state: list[Tokens] = []  # one for each task

    def make(batch):
        if not state:
            state.append(Tokens(path, pattern, added))
        tokens = state[0]
        out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens(text or "") + END
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            for piece, start in enumerate([0, *range(first, n, capacity)]):
                length = first if piece == 0 else capacity
                part = ids[4 * start:4 * (start + length)]
                for name, value in zip(out, (doc_id, piece, start, length, zlib.crc32(part), part)):
                    if name != "ids" or with_ids:
                        out[name].append(value)
        return out

    return map_batches(df.select("doc_id", "text"), make, schema)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The non-negative x with the least |ax - b|, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).sum())):
            break
        active[best] = True
        while True:
            fit = np.zeros_like(x)
            fit[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (fit <= 1e-12)
            if not low.any():
                x = fit
                break
            step = np.min(x[low] / np.maximum(x[low] - fit[low], 1e-300))
            x = x + step * (fit - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """All descending tuples of up to three classes that fill a sequence."""
    return [
        tuple(sorted((p for p in (a, b, classes - a - b) if p), reverse=True))
        for a in range((classes + 2) // 3, classes + 1) for b in range(max(0, (classes - a + 1) // 2), min(a, classes - a) + 1)
    ]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, how often) that use every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    width = -(-capacity // classes)
    kind = -(-np.arange(capacity + 1) // width)
    counts = np.bincount(kind, weights=left, minlength=classes + 1)[1:]
    found, runs = patterns(classes), []
    a = np.zeros((classes, len(found)))
    for j, pattern in enumerate(found):
        for k in pattern:
            a[k - 1, j] += 1
    weight = np.sqrt(np.arange(1, classes + 1))[:, None]
    repeats = np.rint(nnls(a * weight, counts * weight[:, 0])).astype(np.int64) if counts.any() else np.zeros(len(found), np.int64)

    def longest(low: int, high: int) -> int:
        """The longest length left in low..high, or 0."""
        some = np.flatnonzero(left[low:high + 1])
        return low + int(some[-1]) if len(some) else 0

    for j in sorted(np.flatnonzero(repeats), key=lambda j: (found[j], j), reverse=True):
        n = int(repeats[j])
        while n > 0:
            taken = []
            for i, k in enumerate(found[j], 1):  # the last one may use what the others leave of their classes
                high = capacity - sum(taken) if i == len(found[j]) else min(k * width, capacity)
                length = longest((k - 1) * width + 1, high)
                if not length:
                    break
                left[length] -= 1
                taken.append(length)
            times = 1 + min((int(left[t]) // taken.count(t) for t in taken), default=0)
            whole = len(taken) == len(found[j])
            for t in taken:  # what was taken once stays taken, if the pattern is whole
                left[t] -= min(times, n) - 1 if whole else -1
            if not whole:
                break
            runs.append((tuple(taken), min(times, n)))
            n -= min(times, n)
    out = []
    for lengths, n in sorted(runs, key=lambda r: (sum(r[0]), r)):
        todo = [(lengths, n)]
        while todo:
            lengths, n = todo.pop()
            fit = longest(1, capacity - sum(lengths)) if sum(lengths) < capacity and left.any() else 0
            times = min(n, int(left[fit])) if fit else 0
            if n > times and not times:
                out.append((lengths, n))
                continue
            left[fit] -= times
            if n > times:
                todo.append((lengths, n - times))
            todo.append(((*lengths, fit), times))
    while left.any():
        taken, room = [], capacity
        while fit := longest(1, room) if room else 0:
            left[fit] -= 1
            taken.append(fit)
            room -= fit
        again = min(int(left[t]) // taken.count(t) for t in set(taken))
        for t in taken:
            left[t] -= again
        out.append((tuple(taken), 1 + again))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces, evaluated more than once) with sequence_id and offset."""
    runs = plan({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}, capacity)
    rows, used = [], dict.fromkeys(range(capacity + 1), 0)
    for first, (lengths, n) in zip(accumulate([0, *(n for _, n in runs)]), runs):
        for offset, length in zip(accumulate([0, *lengths]), lengths):
            rows.append((length, used[length], first, offset))
            used[length] += n
    rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
    span, names = np.int64(1) << 48, cut.columns
    key = rows[:, 0] * span + rows[:, 1]

    def run(batches):
        for batch in batches:
            rank, length = (np.asarray(batch.column(c)) for c in ("_rank_", "length"))
            at = np.searchsorted(key, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                names=[*names, "sequence_id", "offset"],
            )

    ranked = numbered(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank_")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All texts of ``df`` packed into sequences of at most ``capacity`` tokens, a row a piece.

    A null text counts as empty (one piece, id 0 alone); a null identifier stays null; repeated rows are packed
    each for itself; an empty table gives no rows; other columns of ``df`` are not returned. The pieces are
    written once to the shared folder, without their ids unless asked for.
    """
    return pack(written(pieces(df, capacity, with_ids), "op10-pieces"), capacity)
