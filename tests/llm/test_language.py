"""The language model: base figures exactly, seatings in distribution, held-out perplexity."""

import math
import zlib
from collections import Counter

import numpy as np

from runledger.llm.language import END, LEAST, MOST, START, State, coded, context_of, contexts_for, is_held_out, pack, pitman_yor_scores, seatings, tables, unpack

SCHEMA = "doc_id long, text string, score double"


def test_tables_are_seated_as_by_one_customer_after_the_other():
    random = np.random.default_rng(0)
    for count, weight, discount in ((5, 2.0, 0.5), (60, 0.3, 0.7), (300, 20.0, 0.4), (200, 0.01, 0.9)):
        want = []
        for _ in range(3000):
            t = 1
            for j in range(1, count):
                t += random.random() * (weight + j - discount * t) < weight
            want.append(t)
        n = 20_000
        got = tables(np.full(n, count), np.full(n, weight), discount, np.arange(n, dtype=np.uint64), 3)
        assert abs(got.mean() - np.mean(want)) < 0.03 * np.mean(want) + 0.05 and abs(got.std() - np.std(want)) < 0.1 * np.std(want) + 0.1
        assert got.min() >= 1 and got.max() <= count


def test_predictions_of_a_context_add_up_to_one():
    _, code, context, hashes = coded([" ".join(f"w{min(i, 60)}" for i in np.random.default_rng(2).geometric(0.08, 20_000))])
    pairs = Counter(zip(code.tolist(), context.tolist()))
    words, own = np.unique(hashes[[w for w, _ in pairs]], return_inverse=True)
    at, count = np.array([c for _, c in pairs]), np.array(list(pairs.values()))
    totals = np.zeros(1 << 16, np.int64)
    np.add.at(totals, at, count)
    states, first = [], State(int(count.sum()), len(words), totals, {})
    for _ in range(6):
        *_, (_, t, s) = seatings(states, words, own, at, count)
        state = State.__new__(State)
        state.__dict__.update(first.__dict__)
        state.tables, state.parent = np.bincount(at, weights=t, minlength=1 << 16).astype(np.int64), np.zeros(0, np.int64)
        state.customers, state.parent_tables = int(t.sum()), int(s.sum())
        states.append(state)
    state, t, p = list(seatings(states, words, own, at, count))[-2]
    d, c = state.discounts[0], Counter(context.tolist()).most_common(1)[0][0]
    unknown = (1.0 + state.discounts[1] * state.parent_tables) / (len(words) + 1) / (1.0 + state.customers)
    total = np.maximum(count - d * t, 0)[at == c].sum() + (1.0 + d * state.tables[c]) * (p.sum() + unknown)
    assert abs(total / (1.0 + totals[c]) - 1) < 0.01 and abs(p.sum() + unknown - 1) < 0.02


def test_restaurants_of_previous_words():
    assert [contexts_for(n) for n in (0, 1, LEAST // 2, LEAST // 2 + 1, 400_000, 10**10)] == [LEAST, LEAST, LEAST, 2 * LEAST, 1 << 20, MOST]
    names = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    own = names[::2][:5000]
    at = context_of(own, LEAST, names)
    ours = np.isin(names, own)
    assert sorted(at[ours]) == list(range(1, len(own) + 1)) and START not in at
    assert at[~ours].min() > LEAST // 4 and at.max() < LEAST and len(set(at[~ours])) > 10_000


class Restaurants:
    """The model with every customer, moved one at a time."""

    def __init__(self, pairs, words, discounts, random):
        self.words, self.d, self.random = words, discounts, random
        self.context, self.parent = {}, {}
        self.tables, self.customers, self.parent_tables, self.parent_customers = Counter(), Counter(), 0, 0
        self.pairs = pairs
        for c, w in pairs:
            self.enter(c, w)

    def base(self, w):
        sizes = self.parent.get(w, [])
        return (sum(sizes) - self.d[1] * len(sizes) + (1 + self.d[1] * self.parent_tables) / (self.words + 1)) / (1 + self.parent_customers)

    def seat(self, sizes, d, new):
        """Seats a customer; whether at a new table."""
        at = self.random.random() * (sum(sizes) - d * len(sizes) + new)
        for i, n in enumerate(sizes):
            at -= n - d
            if at < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def rise(self, sizes):
        """A customer leaves; whether the table goes too."""
        i = self.random.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[i] -= 1
        return not sizes[i] and sizes.pop(i) == 0

    def enter(self, c, w):
        new = (1 + self.d[0] * self.tables[c]) * self.base(w)
        self.customers[c] += 1
        if self.seat(self.context.setdefault((c, w), []), self.d[0], new):
            self.tables[c] += 1
            self.parent_tables += self.seat(self.parent.setdefault(w, []), self.d[1], (1 + self.d[1] * self.parent_tables) / (self.words + 1))
            self.parent_customers += 1

    def leave(self, c, w):
        self.customers[c] -= 1
        if self.rise(self.context[c, w]):
            self.tables[c] -= 1
            self.parent_customers -= 1
            self.parent_tables -= self.rise(self.parent[w])

    def sweep(self):
        for c, w in self.pairs:
            self.leave(c, w)
            self.enter(c, w)

    def probability(self, c, w):
        sizes = self.context.get((c, w), [])
        own = sum(sizes) - self.d[0] * len(sizes)
        return (own + (1 + self.d[0] * self.tables[c]) * self.base(w)) / (1 + self.customers[c])


def test_scores_are_near_those_of_single_customers_moved(spark):
    random = np.random.default_rng(5)
    follows = random.dirichlet(np.full(40, 0.15), 40)
    rows = []
    for i in range(20):
        at, text = int(random.integers(40)), []
        for _ in range(60):
            at = int(random.choice(40, p=follows[at]))
            text.append(f"w{at}")
        rows.append((i, " ".join(text), 0.0))
    tokens = {i: [*text.split(), "end"] for i, text, _ in rows}
    learned = [(c, w) for i, t in tokens.items() if not is_held_out(i) for c, w in zip(["start", *t], t)]
    held = [i for i in tokens if is_held_out(i)]
    assert held
    n = Counter(Counter(learned).values())
    model = Restaurants(learned, len({w for _, w in learned}), (min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))), 0.05), random)
    sums, sweeps = Counter(), 60
    for k in range(20 + sweeps):
        model.sweep()
        if k >= 20:
            for i, t in tokens.items():
                for j, (c, w) in enumerate(zip(["start", *t], t)):
                    sums[i, j] += model.probability(c, w) / sweeps
    want = {i: sum(math.log10(sums[i, j]) for j in range(len(t))) for i, t in tokens.items()}
    got = {r.doc_id: r.score for r in pitman_yor_scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, t in tokens.items():
        assert abs(got[i] - want[i]) < 0.03 * abs(want[i]), (i, got[i], want[i])
    assert abs(sum(got[i] for i in held) / sum(want[i] for i in held) - 1) < 0.02


def test_pack():
    a, b = unpack(pack(a=np.arange(5, dtype=np.uint16), b=np.array([], np.int64)), "<u2", "<i8")
    assert a.tolist() == [0, 1, 2, 3, 4] and len(b) == 0 and END != 0


def test_scores(spark):
    real = [(r.doc_id, r.text, 0.0) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    hard = [(5001, None, 0.0), (5002, "", 0.0), (5003, " \n", 0.0), (5004, "The THE the\x1cé É " * 3000, 0.0), (None, "no id", 0.0)]
    rows = real + hard + real[:3] + real[:1] + hard[-1:]
    got = pitman_yor_scores(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    count, tokens = Counter(), {}
    for i, text, _ in rows:
        words = [*(text or "").encode().lower().split(), "end"]
        tokens[i] = words
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(words)
    total, kinds = sum(count.values()), len(count)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    for r in got:
        words = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words)
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), total, sum(w in count for w in words))
        assert abs(r.base_score - base) < 1e-9 * abs(base) + 1e-9 and r.score < 0
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.3  # perplexity under half
    again = {(r.doc_id, round(r.score, 6)) for r in pitman_yor_scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in got}
    assert pitman_yor_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pitman_yor_scores(spark.createDataFrame([(2, None, 0.0), (16, "x", 0.0)], SCHEMA)).count() == 2
