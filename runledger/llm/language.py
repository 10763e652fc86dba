"""Scoring by a hierarchical Pitman-Yor model of word pairs.

A context restaurant serves the words that follow one previous word. There are twice as many restaurants as words, as a
power of two from ``LEAST`` to ``MOST``, so that what every task must know stays bounded. Each previous word above 4 /
restaurants of all tokens has a restaurant of its own, as has the start of a text; the others are hashed to the rest. All
restaurants share one parent, the restaurant of single words, whose own base is uniform. Customers of the parent are the
tables of the contexts.

Each text sends its (context, word) pairs once, packed by batch, to shards of the vocabulary. A shard counts its
pairs and keeps, pair by pair, the texts that need them. Words above 1 / ``FREQUENT`` of all tokens are known
to all shards and their pairs are dealt out by word and context, so no word makes a shard hot.

The Gibbs sampler runs in parallel. One customer at a time would be taken out and seated again given all others; here a
sweep takes out all customers of a pair and seats them again by the same rule, one after the other, while the number of
tables of the context and the parent's probability of the word are those of the last sweep. All pairs are seated at once,
then shards exchange the table counts of contexts and of frequent words. This is an approximation, as pairs of a context
do not see each other's new tables within a sweep; a test holds it against the sampler that moves single customers. The
discounts are estimated from counts of counts, the strength is fixed. A seating is a function of the pair, the sweep and
those counts, so a shard makes it anew where it is needed, and a lost task gives the same one again. Predictive
probabilities are averaged over the samples after ``BURN_IN`` sweeps.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import map_batches, word_count
from runledger.llm.jaccard import STEPS, blocks_of, mixed
from runledger.session import written

LEAST, MOST = 1 << 16, 1 << 20  # restaurants
CHUNK = 1 << 14  # restaurants that are added up together
FREQUENT = 10_000
SHARDS = 64
SHARD_TOKENS = 2_000_000
SLICE = 500  # texts that a task holds as Python strings at a time, under 2 ** 16
BLOCK_CHARS = 2_000_000
BURN_IN = 2
SAMPLES = 3
STRENGTH = 1.0

END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))  # no word holds a blank
START = 0  # the context before a text; those of words with a restaurant of their own come next
NONE = np.zeros(0, np.uint64)
ARRAYS = ("context", "frequent", "frequent_count", "tables", "parent")  # of a state


def place(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among sorted names, or -1."""
    if not len(names):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
    return np.where(names[at] == words, at, -1)


def contexts_for(words: int) -> int:
    return min(MOST, max(LEAST, 1 << (2 * words - 1).bit_length())) if words else LEAST


def context_of(own: np.ndarray, contexts: int, words: np.ndarray) -> np.ndarray:
    """The restaurant of what follows each word; ``own``: the words with one of their own, at most ``contexts`` / 4."""
    at, first = place(own, words), 1 + contexts // 4
    return np.where(at >= 0, 1 + at, first + ((words >> np.uint64(16)) % np.uint64(contexts - first)).astype(np.int64))


def coded(texts: list[str | None], own: np.ndarray = NONE, contexts: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of all texts: text, code of the word, context; and the hash of each code (0: the end)."""
    words = [[*(t or "").encode().lower().split(), b" end "] for t in texts]
    code: defaultdict[bytes, int] = defaultdict(None, {b" end ": 0})
    code.default_factory = code.__len__  # a new word gets the next number
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in code], np.uint64)
    hashes[0] = END
    before = np.empty(len(flat), np.int64)
    before[1:] = context_of(own, contexts, hashes)[flat[:-1]]
    before[np.cumsum(n) - n] = START
    return np.repeat(np.arange(len(texts)), n), flat, before, hashes


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def pack(**arrays: np.ndarray) -> bytes:
    """Integer arrays of any lengths as one compressed value: all first bytes of an array, then all second ones and so on."""
    head = np.array([len(a) for a in arrays.values()], np.int64)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values())
    return zstandard.ZstdCompressor(1).compress(head.tobytes() + b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), map(np.dtype, kinds)):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += out[-1].nbytes
    return out


def uniform(key: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1] for each key: the same for the same key, seed and step."""
    salt = np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return ((mixed(key + salt) >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def tables(count: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, seed: int) -> np.ndarray:
    """Tables after ``count`` customers who want the same dish, ``weight`` being that of a new table.

    The first customers are seated one by one. After that the number of customers until the next new table is
    drawn at once, from the ratio of gamma functions that a run of customers at old tables has as its probability.
    """
    t = (count > 0).astype(np.int64)
    active, seated = np.flatnonzero(count > 1), 1
    while len(active) and seated < 8:
        new = weight[active]
        t[active] += uniform(key[active], seed, seated) * (new + seated - discount * t[active]) <= new
        seated += 1
        active = active[count[active] > seated]
    at, step = np.full(len(active), float(seated)), 8
    while len(active):
        new = np.maximum(weight[active], 1e-12)
        base = at - discount * t[active] + (new - 1) / 2
        with np.errstate(over="ignore"):
            at = at + 1 + np.floor(base * np.expm1(-np.log(uniform(key[active], seed, step)) / new))
        step += 1
        more = at <= count[active]
        t[active[more]] += 1
        active, at = active[more], at[more]
        left = count[active] > at
        active, at = active[left], at[left]
    return t


class State:
    """What the shards share: sizes, counts of contexts and frequent words, and the last sweep's tables."""

    def __init__(self, tokens: int, words: int, context: np.ndarray, frequent: dict[int, int]):
        self.tokens, self.words, self.context = tokens, words, context
        self.frequent = np.sort(np.array(list(frequent), np.int64).view(np.uint64))
        self.frequent_count = np.array([frequent[int(x)] for x in self.frequent.view(np.int64)], np.int64)
        self.tables = self.parent = None
        self.customers = self.parent_tables = 0
        self.discounts = (0.5, 0.5)

    def __getstate__(self):
        """What goes to the tasks: counts as the smallest numbers that hold them, packed."""
        least = {k: v.astype(np.min_scalar_type(v.max(initial=0))) if isinstance(v, np.ndarray) and k != "frequent" else v for k, v in self.__dict__.items()}
        return {k: (str(v.dtype), pack(v=v)) if isinstance(v, np.ndarray) else v for k, v in least.items()}

    def __setstate__(self, found):
        self.__dict__.update({k: unpack(found[k][1], found[k][0])[0] if k in ARRAYS and v is not None else v for k, v in found.items()})

    def place(self, words: np.ndarray) -> np.ndarray:
        return place(self.frequent, words)

    def unigram(self, words: np.ndarray, customers: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The parent's probabilities of words with so many customers each, and its tables."""
        d = self.discounts[1]
        new = (STRENGTH + d * self.parent_tables) / (self.words + 1)
        t = tables(customers, np.full(len(words), new), d, words, seed)
        return (np.maximum(customers - d * t, 0) + new) / (STRENGTH + self.customers), t


def sharing(states: list[State]) -> list[State]:
    """The states, with one copy of what they have in common."""
    for state in states[1:]:
        state.context, state.frequent, state.frequent_count = states[0].context, states[0].frequent, states[0].frequent_count
    return states


def seatings(states: list[State], words: np.ndarray, own: np.ndarray, context: np.ndarray, count: np.ndarray):
    """The seatings of the pairs of a shard: for each state, (state, tables, parent's probabilities).

    Pairs are (word, context) with counts; ``own`` is the place of a pair's word in ``words``. The first seating
    has a table for each pair, and every state holds the sums of its seating over all shards. A last item has the
    seating that follows from the last state, and the parent's tables in place of probabilities.
    """
    key, t = mixed(words[own] + context.astype(np.uint64) * STEPS[2]), (count > 0).astype(np.int64)
    place = states[0].place(words) if states else None
    for seed, state in enumerate(states):
        customers = np.bincount(own, weights=t, minlength=len(words)).astype(np.int64)
        customers[place >= 0] = state.parent[place[place >= 0]]
        p, _ = state.unigram(words, customers, seed)
        yield state, t, p
        weight = STRENGTH + state.discounts[0] * state.tables[context]
        t = tables(count, weight * p[own], state.discounts[0], key, seed)
    customers = np.bincount(own, weights=t, minlength=len(words)).astype(np.int64)
    yield None, t, states[-1].unigram(words, customers, len(states))[1] if states else (customers > 0).astype(np.int64)


def shard_arrays(row) -> tuple[np.ndarray, ...]:
    words, pairs, context, count = unpack(row["seats"], "<u8", "<u4", "<u4", "<u8")
    return words, np.repeat(np.arange(len(words)), pairs), context.astype(np.int64), count.astype(np.int64)


def exchange(shards: DataFrame, state: State, states: list[State]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all shards of the seating that follows from ``states``: tables of contexts, customers of frequent words, and six sums.

    Each task adds up its shards and sends an array for each ``CHUNK`` of contexts and one for the rest; the sums of
    these arrays, MOST + FREQUENT + 6 numbers at most, come back.
    """
    size, n_frequent = len(state.context), len(state.frequent)

    def run(frames):
        context, frequent, sums = np.zeros(size, np.int64), np.zeros(n_frequent, np.int64), np.zeros(6, np.int64)
        sharing(states)
        for f in frames:
            for row in f.to_dict("records"):
                words, own, at, count = shard_arrays(row)
                for _, t, s in seatings(states, words, own, at, count):
                    pass  # one seating at a time is held; the last counts
                context += np.bincount(at, weights=t, minlength=size).astype(np.int64)
                customers = np.bincount(own, weights=t, minlength=len(words)).astype(np.int64)
                place = state.place(words)
                frequent += np.bincount(place[place >= 0], weights=customers[place >= 0], minlength=n_frequent).astype(np.int64)
                local = place < 0
                sums += [customers.sum(), (s[local] * (customers[local] > 0)).sum(), (count == 1).sum(), (count == 2).sum(),
                         (customers[local] == 1).sum(), (customers[local] == 2).sum()]
        parts = [np.append(sums, frequent), *(context[at:at + CHUNK] for at in range(0, size, CHUNK))]
        yield pd.DataFrame({"part": range(len(parts)), "data": [pack(sums=x) for x in parts]})

    def add(frame):
        total = sum(unpack(data, "<i8")[0] for data in frame["data"])
        return pd.DataFrame({"part": frame["part"][:1].to_numpy(), "data": [pack(sums=total)]})

    schema = "part int, data binary"
    rows = shards.select("seats").mapInPandas(run, schema).groupBy("part").applyInPandas(add, schema).collect()
    first, *rest = [unpack(r["data"], "<i8")[0] for r in sorted(rows, key=lambda r: r["part"])] or [np.zeros(6 + n_frequent, np.int64), np.zeros(size, np.int64)]
    return np.concatenate(rest), first[6:], first[:6]


def updated(state: State, shards: DataFrame, states: list[State]) -> State:
    """The state of the seating that follows from ``states``, which may be none yet."""
    context, frequent, sums = exchange(shards, state, states)
    new = State.__new__(State)
    new.__dict__.update(state.__dict__)
    new.tables, new.parent = context, frequent
    new.customers, local, n1, n2, k1, k2 = map(int, sums)
    if not states:
        new.discounts = tuple(min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in ((n1, n2), (k1, k2)))
    new.parent_tables = local + int((new.parent > 0).sum())
    return new


def pitman_yor_scores(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``df``.

    Tokens are the words of the text in lower-case A-Z and one end. The model learns from texts whose
    crc32(doc_id as text) mod 7 is not 2. base_score: add-one unigram log10 probability; score: that of the model.
    Null texts count as empty (an end alone); a null doc_id counts as the empty string and is learned from; repeated
    rows are learned from as often as they occur and get equal results. Without any text to learn from, words are
    uniform over one. An empty table gives no rows; other columns are not returned.
    """
    docs = df.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def blocks(batch):
        for at in range(0, len(batch), SLICE):
            rows, ids, texts = (batch.column(c).slice(at, SLICE).to_pylist() for c in range(3))
            first = 0
            for own, part in blocks_of(ids, texts, BLOCK_CHARS):
                yield rows[first:first + len(part)], own, part
                first += len(part)

    def count(batch):
        for _, own, texts in blocks(batch):
            learned = [t for i, t in zip(own, texts) if not is_held_out(i)]
            if learned:
                _, code, _, hashes = coded(learned)
                n = np.bincount(code, minlength=len(hashes))
                yield {"w": hashes.view(np.int64), "c": n}

    words = written(map_batches(docs, count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where("c > 0"), "op9-words")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end, common = int(END.view(np.int64)), F.col("c") * FREQUENT > tokens
    frequent = {r["w"]: r["c"] for r in words.where(common).collect()}
    contexts = contexts_for(vocabulary)
    named = (F.col("c") * (contexts // 4) > tokens) & (F.col("w") != end)
    own_counts = {r["w"]: r["c"] for r in words.where(named).collect()}
    own_words = np.sort(np.array(list(own_counts), np.int64).view(np.uint64))
    context = np.zeros(contexts, np.int64)
    first = 1 + contexts // 4  # as in context_of
    slot = F.shiftrightunsigned("w", 16) % (contexts - first) + first
    for r in words.where((F.col("w") != end) & ~named).groupBy(slot.cast("int").alias("k")).agg(F.sum("c").alias("c")).toLocalIterator():
        context[r["k"]] = r["c"]
    context[1:1 + len(own_words)] = [own_counts[int(w)] for w in own_words.view(np.int64)]
    context[START] = sum(r["c"] for r in words.where(F.col("w") == end).collect())
    state, n_shards = State(tokens, vocabulary, context, frequent), max(SHARDS, -(-tokens // SHARD_TOKENS))

    def send(batch):
        for rows, own_ids, part in blocks(batch):
            names = np.array(rows, np.int64)
            own, code, context, hashes = coded(part, own_words, contexts)
            # one number for word, context and text: its runs are the distinct pairs of each text
            key, n = np.unique((code << 36) | (context << 16) | own, return_counts=True)
            code, context, own = key >> 36, (key >> 16) & 0xFFFFF, key & 0xFFFF
            spread = np.where(state.place(hashes) >= 0, STEPS[2], np.uint64(0))[code]
            shard = (mixed(hashes[code] + context.astype(np.uint64) * spread) % np.uint64(n_shards)).astype(np.min_scalar_type(n_shards))
            by = np.argsort(shard, kind="stable")
            learned = np.array([not is_held_out(i) for i in own_ids])
            edges = np.flatnonzero(np.diff(shard[by])) + 1
            out = {"shard": [], "data": []}
            for places in np.split(by, edges):
                first = np.flatnonzero(np.append(True, np.diff(code[places]) != 0))
                held = np.zeros(len(part), bool)
                held[own[places]] = True
                used, doc = np.flatnonzero(held), (np.cumsum(held, dtype=np.uint32) - np.uint32(1))[own[places]]
                out["shard"].append(int(shard[places[0]]))
                out["data"].append(pack(
                    words=hashes[code[places[first]]], entries=np.diff(np.append(first, len(places))).astype(np.uint32),
                    context=context[places].astype(np.uint32), doc=doc, n=n[places].astype(np.uint32),
                    rows=names[used], learned=learned[used].astype(np.uint8),
                ))
            yield out

    def gather(frame):
        """All entries of a shard, sorted by word and context; the pairs and the texts that hold them."""
        word, entries, context, doc, n, rows, learned = [], [], [], [], [], [], []
        for data in frame["data"]:
            w, e, c, d, m, r, ok = unpack(data, "<u8", "<u4", "<u4", "<u4", "<u4", "<i8", "u1")
            word.append(w)
            entries.append(e)
            context.append(c)
            doc.append(d + np.uint32(sum(map(len, rows))))
            n.append(m)
            rows.append(r)
            learned.append(m * ok[d])
        rows, same = np.unique(np.concatenate(rows), return_inverse=True)  # equal rows are one text, as often as they occur
        doc = same.astype(np.uint32)[np.concatenate(doc)]
        # one number for word and context: a sort of numbers
        words, code = np.unique(np.concatenate(word), return_inverse=True)
        key = np.repeat(code.astype(np.uint64) << np.uint64(32), np.concatenate(entries)) | np.concatenate(context)
        n, learned = map(np.concatenate, (n, learned))  # what is not used below is freed
        del word, entries, context, code
        by = np.argsort(key)
        key = key[by]
        pair = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.add.reduceat(learned[by], pair, dtype=np.uint64)
        doc, n, size = doc[by], n[by], len(key)
        word, context = (key[pair] >> np.uint64(32)).astype(np.int64), key[pair].astype(np.uint32)
        del learned, by, key
        first = np.flatnonzero(np.append(True, np.diff(word) != 0))
        return pd.DataFrame({
            "shard": frame["shard"][:1].to_numpy(),
            "seats": [pack(words=words[word[first]], pairs=np.diff(np.append(first, len(pair))).astype(np.uint32),
                           context=context, count=count)],
            "texts": [pack(entries=np.diff(np.append(pair, size)).astype(np.uint32), doc=doc, n=n, rows=rows)],
        })

    sent = map_batches(docs, send, "shard int, data binary")
    shards = written(sent.groupBy("shard").applyInPandas(gather, "shard int, seats binary, texts binary"), "op9-shards")
    states: list[State] = []
    for _ in range(BURN_IN + SAMPLES):
        states.append(updated(state, shards, states))

    def score(frames):
        sharing(states)
        for f in frames:
            for row in f.to_dict("records"):
                words, own, at, count = shard_arrays(row)
                place, known = state.place(words), np.bincount(own, weights=count, minlength=len(words)).astype(np.int64)
                known[place >= 0] = state.frequent_count[place[place >= 0]]
                p = np.zeros(len(own))
                for s, t, parent in islice(seatings(states, words, own, at, count), BURN_IN, BURN_IN + SAMPLES):
                    d = s.discounts[0]
                    p += (np.maximum(count - d * t, 0) + (STRENGTH + d * s.tables[at]) * parent[own]) / (STRENGTH + s.context[at])
                entries, doc, n, rows = unpack(row["texts"], "<u4", "<u4", "<u4", "<i8")
                pair = np.repeat(np.arange(len(own), dtype=np.uint32), entries)
                add = lambda each: np.bincount(doc, weights=each[pair] * n, minlength=len(rows))
                known = known[own]
                base = np.log10((known + 1) / (state.tokens + state.words + 1))
                yield pd.DataFrame({"row": rows, "known": add(known > 0).astype(np.int64), "base": add(base), "model": add(np.log10(p / SAMPLES))})

    sums = shards.select("seats", "texts").mapInPandas(score, "row long, known long, base double, model double").groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("known", "base", "model")))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = docs.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.first(word_count() + 1).alias("n_tokens"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.join(sums, "row").withColumn("copy", copy).select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("model") / F.col("copies")).alias("score"))
