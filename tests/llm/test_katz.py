"""The language model against a plain program."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgraph.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """Katz backoff by recursion over dictionaries. Before a text stands one context, for all orders."""

    def __init__(self, texts, order):
        self.order, self.follow = order, [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            for context, w in self.grams(t):
                for k in range(order):
                    self.follow[k][self.cut(context, k)][w] += 1
        counts = [Counter(n for f in by.values() for n in f.values()) for by in self.follow]
        self.d = [katz.discounts([c[r] for r in range(1, katz.CUT + 2)]) for c in counts]
        self.words = self.follow[0][()]
        self.kept = {}

    def grams(self, text):
        tokens = [*WORD.findall((text or "").translate(LOW)), None]
        return [(tokens[:i], w) for i, w in enumerate(tokens)]

    def cut(self, context, k):
        return tuple(context[len(context) - k :]) if len(context) >= k else ("<", *context)

    def p(self, context, w, k):
        if k < 0:
            return 0.0 if w in self.words else 1.0
        own, shorter = self.cut(context, k), self.p(context, w, k - 1)
        f = self.follow[k].get(own)
        if not f:
            return shorter
        if (k, own) not in self.kept:
            few = any(n <= katz.CUT for n in f.values())
            whole = sum(f.values()) + (not few)
            seen = sum(self.share(k, n, whole) for n in f.values())
            self.kept[k, own] = whole, (1 - seen) / (1 - sum(self.p(context, x, k - 1) for x in f))
        whole, alpha = self.kept[k, own]
        return self.share(k, f[w], whole) if f[w] else alpha * shorter

    def share(self, k, n, whole):
        return (self.d[k][n - 1] if n <= katz.CUT else 1) * n / whole

    def score(self, text):
        known = [w if w in self.words else 0 for _, w in self.grams(text)]
        return sum(math.log10(self.p(c, w, self.order - 1)) for (c, _), w in zip(self.grams(text), known))


def told(data):
    return [t for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]


def scored(spark, data, order, model=None):
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumns({"block": F.lit(1), "TRAIN": F.lit(2)})
    cut = katz.blocks(docs, train=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    model, found = katz.learned_and_scored(cut, order, model)
    return model, found.collect()


def check(data, model, found, order):
    plain = Plain(told(data), order)
    n, v = sum(plain.words.values()), len(plain.words)
    want = []
    for i, t in data:
        words = [w for _, w in plain.grams(t)]
        base = sum(math.log10((plain.words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((str(i), len(words), sum(w in plain.words for w in words), round(base, 7), round(plain.score(t), 7)))
    assert sorted((str(r[0]), r[1], r[2], round(r[3], 7), round(r[4], 7)) for r in found) == sorted(want)
    assert (model.tokens, model.orders[0].distinct) == (n, v)


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [" ".join(rng.choice(words) if rng.random() < 0.9 else f"Rare{rng.randrange(10**6)}" for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 2000)
    monkeypatch.setattr(katz, "TOKENS", 500)
    monkeypatch.setattr(katz, "HOT", 20)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_a_plain_program(spark, small, order):
    data = list(enumerate(texts(150, order)))
    data += [(3, "again"), (3, "again"), (None, "no key w1"), (500, None), (501, ""), (502, " \t\n"), (503, "É é É"), (504, "w1 " * 3000), *((i, "one and the same text") for i in range(600, 660))]
    model, found = scored(spark, data, order)
    assert model.parts > 3 and (order == 1 or len(model.orders[1].hot) > 1)
    check(data, model, found, order)


def test_stored_model_scores_other_texts(spark, small):
    data = list(enumerate(texts(100, 7)))
    model, found = scored(spark, data, 2)
    other = [(i * 5, t) for i, t in enumerate(texts(40, 8))]
    again, new = scored(spark, other, 2, model)
    plain = Plain(told(data), 2)
    assert sorted((r.doc_id, round(r.score, 7)) for r in new) == sorted((i, round(plain.score(t), 7)) for i, t in other)
    assert again.orders == model.orders


def test_probabilities_sum_to_one(spark, small):
    """Of contexts with few and many, rare and frequent followers: scores of one more word differ by its probability."""
    data = [(5 * i, t) for i, t in enumerate(["a b", "a c", "a a a a b b", "b a", "d d d d d d d d d"] * 3) if zlib.crc32(str(5 * i).encode()) % 5 != 1]
    model, _ = scored(spark, data, 2)
    vocabulary = [None, *sorted({w for _, t in data for w in t.split()}), "unknown"]
    plain = Plain(told(data), 2)
    for context in (["a"], ["b"], ["d"], [], ["unknown"]):
        assert math.isclose(sum(plain.p(context, w if w != "unknown" else 0, 1) for w in vocabulary), 1, rel_tol=1e-12)
    asked = [(i, " ".join(x)) for i, x in enumerate([["a"], ["b"], ["d"], ["a", "d"], ["d", "unknown"]])]
    assert sorted((r.doc_id, round(r.score, 9)) for r in scored(spark, asked, 2, model)[1]) == [(i, round(plain.score(t), 9)) for i, t in asked]


def test_no_rows_and_nothing_to_learn_from(spark):
    assert scored(spark, [], 2)[1] == []
    none = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    found = scored(spark, [(i, "some words") for i in none], 2)[1]
    assert [(r.n_tokens, r.n_known, r.score) for r in found] == [(3, 0, 0.0)] * 3


def test_discounts():
    assert all(0 < d < 1 for counts in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [1000, 300, 150, 90, 60, 42]) for d in katz.discounts(counts))
    n = [1000, 300, 150, 90, 60, 42]
    rest = 6 * n[5] / n[0]
    assert np.allclose(katz.discounts(n), [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, 6)])
    assert math.isclose(sum((1 - d) * r * n[r - 1] for r, d in enumerate(katz.discounts(n), 1)), n[0])  # what is discounted is what Good-Turing gives the unseen


def test_arrays_pack():
    for x in (np.zeros(0, np.int64), np.array([0, 255, 3]), np.array([2**63 + 5, 1], np.uint64), np.array([0.1, -2.5])):
        assert np.array_equal(katz.unpacked_array(katz.packed_array(x)), x)
