"""The language model's seating and scores against enumeration and against a sequential sampler in plain Python."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import common, lm
from tests.llm.test_llm import table


def partitions(n, most=None):
    most = most or n
    if n == 0:
        yield ()
    for k in range(min(n, most), 0, -1):
        for rest in partitions(n - k, k):
            yield (k, *rest)


def exact(n, theta, d, p):
    """The probability of each multiset of table sizes for one dish under the seating rule."""
    out = {}
    for sizes in partitions(n):
        ways = math.factorial(n)
        for k, times in Counter(sizes).items():
            ways //= math.factorial(k) ** times * math.factorial(times)
        weight = ways
        for i in range(len(sizes)):
            weight *= (theta + d * i) * p
        for k in sizes:
            for j in range(1, k):
                weight *= j - d
        out[sizes] = weight
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_moves_keep_the_exact_distribution():
    n, theta, d, p, dishes = 5, 0.8, 0.4, 0.3, 20_000
    ones = np.ones(dishes, np.int64)
    s = lm.Seating(n * ones, ones, n * ones, n * ones, d, np.random.default_rng(1))

    def step(a):
        s.remove(a)
        s.add(a, (theta + d * s.t[a]) * p)

    for _ in range(12):
        s.steps(np.full(dishes, n), step)
    assert (s.n == n).all() and s.sizes().sum() == n * dishes
    tables = np.split(s.sizes(), np.cumsum(s.t)[:-1])
    seen = Counter(tuple(sorted(x.tolist(), reverse=True)) for x in tables)
    for sizes, share in exact(n, theta, d, p).items():
        assert seen[sizes] / dishes == pytest.approx(share, abs=0.02), sizes
    # the same for one dish with many moves
    one, seen = lm.Dish(np.array([n]), d, np.random.default_rng(2)), Counter()
    for _ in range(20_000):
        one.move(2, lambda t: (theta + d * t) * p)
        seen[tuple(sorted(one.sizes.tolist(), reverse=True))] += 1
    for sizes, share in exact(n, theta, d, p).items():
        assert seen[sizes] / 20_000 == pytest.approx(share, abs=0.03), sizes


def test_customers_come_and_go():
    rng = np.random.default_rng(3)
    n, t = np.array([0, 1, 4, 100]), np.array([0, 1, 2, 30])
    s = lm.Seating(n, t, lm.first_sizes(n, t, 0.5), np.array([3, 3, 4, 120]), 0.5, rng)
    s.steps(np.array([3, 2, 0, 20]), lambda a: s.add(a, np.ones(len(a))))
    assert s.n.tolist() == [3, 3, 4, 120] and s.sizes().sum() == 130
    s.steps(np.array([3, 1, 4, 120]), s.remove)
    assert s.n.tolist() == [0, 2, 0, 0] and s.t.tolist()[0] == 0 and s.sizes().sum() == 2
    assert lm.first_sizes(np.array([10, 0, 7]), np.array([3, 0, 7]), 0.5).tolist()[3:] == [1] * 7
    assert lm.first_sizes(np.array([10, 0, 7]), np.array([3, 0, 7]), 0.5)[:3].sum() == 10


def one_by_one(n, theta, d, p, rng):
    """Tables of a dish of n customers, all of them alone, after each has been moved once by itself."""
    table, sizes, t = list(range(n)), [1] * n, n
    for i in range(n):
        sizes[table[i]] -= 1
        t -= not sizes[table[i]]
        k = rng.choices(range(n), [max(x - d, 0) for x in sizes])[0]
        if rng.random() * (n - 1 - d * t + (theta + d * t) * p) < (theta + d * t) * p:
            k = sizes.index(0)
            t += 1
        sizes[k] += 1
        table[i] = k
    return t


def test_a_sweep_moves_every_customer():
    """A sweep leaves large dishes, all of whose customers sat alone, with as many tables as moving one after the other, at the root of a bucket and as hot ones."""
    n, theta, d, p, dishes = 600, 2.0, 0.5, 0.3, 60
    rng = random.Random(6)
    want = sum(one_by_one(n, theta, d, p, rng) for _ in range(15)) / 15
    assert want < n / 2
    alone = np.ones(n * dishes, np.int64)
    before = SimpleNamespace(customers=np.full(dishes, n), root_tables=np.full(dishes, n), root_sizes=alone)
    s, last = SimpleNamespace(customers=np.full(dishes, n)), SimpleNamespace(root_weight=lambda t, d: (theta + d * (n + t)) * p)
    lm.Bucket.at_root(SimpleNamespace(hot_word=np.zeros(dishes, bool)), s, before, 2, last, d, np.random.default_rng(4))
    assert s.root_sizes.sum() == n * dishes and (s.root_sizes > 0).all() and s.root_tables.sum() == len(s.root_sizes)
    assert s.root_tables.mean() == pytest.approx(want, rel=0.05)
    word, hot = 7, []
    for seed in range(20):
        now, old = lm.Sums(), SimpleNamespace(sizes={(1, word): np.ones(n, np.int64)}, hot_words={word: [n, n, n]}, root_weight=last.root_weight)
        now.hot_words = {word: [n, n, 0.0]}
        lm._hot_sweep(now, old, 2 + seed, (d, d), {})
        assert now.sizes[1, word].sum() == n
        hot.append(now.hot_words[word][2])
    assert np.mean(hot) == pytest.approx(want, rel=0.05)


def test_customers_leave_and_come_in_groups():
    rng = np.random.default_rng(3)
    n, t = np.array([500, 2, 40]), np.array([20, 1, 5])
    s = lm.Seating(n, t, lm.first_sizes(n, t, 0.5), np.array([500, 900, 40]), 0.5, rng)
    s.leave(np.array([480, 0, 40]))
    s.come(np.array([0, 898, 3]), lambda a: np.ones(len(a)))
    assert s.n.tolist() == [20, 900, 3] and s.sizes().sum() == 923
    s.sweep(lambda a, t: 1 + 0.5 * t)
    assert s.n.tolist() == [20, 900, 3] and s.sizes().sum() == 923 and s.t.sum() == len(s.sizes())


def pairs_of(texts):
    out = []
    for t in texts:
        w = [*(t or "").encode().lower().split(), None]
        out.append(list(zip(["start", *w[:-1]], w, strict=True)))
    return out


def discounts_of(count):
    of = lambda a, b: min(max(a / (a + 2 * b), 0.05), 0.95) if a + b else 0.5
    parents = Counter(w for _, w in count)
    pick = lambda c, k: sum(v == k for v in c.values())
    return of(pick(count, 1), pick(count, 2)), of(pick(parents, 1), pick(parents, 2))


class Restaurant:
    def __init__(self, d, theta, parent, p0=None):
        self.d, self.theta, self.parent, self.p0, self.tables, self.n, self.t = d, theta, parent, p0, {}, 0, 0

    def p(self, w):
        base = self.parent.p(w) if self.parent else self.p0
        own = self.tables.get(w, ())
        return (sum(own) - self.d * len(own) + (self.theta + self.d * self.t) * base) / (self.theta + self.n)

    def add(self, w, rng):
        own = self.tables.setdefault(w, [])
        base = self.parent.p(w) if self.parent else self.p0
        weights = [k - self.d for k in own] + [(self.theta + self.d * self.t) * base]
        i = rng.choices(range(len(weights)), weights)[0]
        self.n += 1
        if i < len(own):
            own[i] += 1
        else:
            own.append(1)
            self.t += 1
            if self.parent:
                self.parent.add(w, rng)

    def remove(self, w, rng):
        own = self.tables[w]
        i = rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        self.n -= 1
        if not own[i]:
            del own[i]
            self.t -= 1
            if self.parent:
                self.parent.remove(w, rng)


def sequential(train, score, sweeps=40, burn=15):
    """Log10 scores by a sampler that moves one customer after the other through both levels."""
    rng = random.Random(5)
    count = Counter(p for t in train for p in t)
    d, d0 = discounts_of(count)
    root = Restaurant(d0, lm.THETA0, None, 1 / (len({w for _, w in count}) + 1))
    rooms = {}
    room = lambda k: rooms.setdefault(k, Restaurant(d, lm.THETA, root))
    tokens = [p for t in train for p in t]
    for k, w in tokens:
        room(k).add(w, rng)
    sums = Counter()
    for sweep in range(sweeps):
        for k, w in tokens:
            rooms[k].remove(w, rng)
            rooms[k].add(w, rng)
        if sweep >= burn:
            for p in {p for t in score for p in t}:
                sums[p] += (rooms[p[0]].p(p[1]) if p[0] in rooms else root.p(p[1])) / (sweeps - burn)
    return [sum(math.log10(sums[p]) for p in t) for t in score]


def test_scores_where_seating_is_certain(spark):
    """Every word occurs once, so every dish has one customer: the score follows from the counts alone."""
    texts = ["a b c", "d e", "f"] + ["a c q", "b e f", ""]
    out = lm.score(common.store(table(spark, texts), "docs"), F.col("doc_id") >= 3).toPandas().set_index("doc_id")
    # end tokens occur three times, in three contexts; their parent dish alone is open, with at most three tables
    d, d0 = discounts_of(Counter(p for t in pairs_of(texts[:3]) for p in t))
    for tables in ((1, 2, 3),):
        v, customers = 7, 9
        for i in (3, 4):
            bounds = []
            for t in tables:
                root = lambda w, t=t: ((1 - d0 if w in (b"a", b"b", b"c", b"d", b"e", b"f") else 3 - d0 * t if w is None else 0) + (1 + d0 * (6 + t)) / (v + 1)) / (1 + customers)
                own = {("start", b"a"), ("start", b"d"), ("start", b"f"), (b"a", b"b"), (b"b", b"c"), (b"c", None), (b"d", b"e"), (b"e", None), (b"f", None)}
                size = Counter(k for k, _ in own)
                p = lambda k, w, root=root: ((1 - d) * ((k, w) in own) + (1 + d * size[k]) * root(w)) / (1 + size[k])
                bounds.append(sum(math.log10(p(k, w)) for k, w in pairs_of(texts)[i]))
            assert min(bounds) - 1e-9 <= out.score[i] <= max(bounds) + 1e-9


@pytest.mark.parametrize("bucket", [150, 1_000_000])  # with 150, most words and many pairs are hot
def test_scores_near_a_sequential_sampler(spark, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    rng = random.Random(11)
    follow = {w: rng.choices("abcdefghijkl", k=4) for w in "abcdefghijkl"}
    texts = []
    for _ in range(60):
        w, words = rng.choice("abcdefghijkl"), []
        for _ in range(rng.randrange(4, 25)):
            words.append(w if rng.random() < 0.9 else f"r{rng.randrange(40)}")
            w = rng.choice(follow[w])
        texts.append(" ".join(words))
    held = 45
    out = lm.score(common.store(table(spark, texts), "docs"), F.col("doc_id") >= held).toPandas().set_index("doc_id")
    pairs = pairs_of(texts)
    want = sequential(pairs[:held], pairs[held:])
    tokens = [len(p) for p in pairs[held:]]
    got = [out.score[i] for i in range(held, len(texts))]
    # hot pairs don't count in the discounts here, but do in the sequential sampler
    assert sum(got) / sum(tokens) == pytest.approx(sum(want) / sum(tokens), abs=0.02 if bucket > 1000 else 0.04)
    assert max(abs(a - b) / n for a, b, n in zip(got, want, tokens, strict=True)) < 0.1
