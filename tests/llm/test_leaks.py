"""Decontamination against brute force, and how much of what was reworded is found."""

import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgraph.llm import decontaminate as D


def brute_stretch(same):
    best = 0
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            n = sum(same[a:b])
            if n >= 0.8 * (b - a) - 1e-9:
                best = max(best, n)
    return best


def test_stretches_equal_brute_force():
    r = random.Random(1)
    for _ in range(300):
        same = [r.random() < r.choice((0.5, 0.8, 0.9)) for _ in range(r.randint(0, 30))]
        assert D.matched(np.array(same, bool)) == brute_stretch(same)


def test_a_rewritten_middle_leaves_what_is_around_it():
    assert D.matched(np.array([True] * 30 + [False] * 14 + [True] * 15)) == 30


def test_tokens_are_runs_of_letters_and_digits():
    texts = ["Aé b_c  ÀÉ1!", "", "x", "日本 語", "x", "..."]
    values, bounds = D.tokens(texts)
    said = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in said]
    flat = [w for s in said for w in s]
    assert len(set(flat)) == len(set(values.tolist())) and all((a == b) == (x == y) for (a, x), (b, y) in pairwise(zip(flat, values.tolist())))
    assert D.tokens([])[0].tolist() == []


def brute(docs, items):
    out = set()
    for d, text in docs.items():
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for k, item in items.items():
            own = re.findall(r"[^\W_]+", item.lower())
            best = 0
            for at in range(-len(own) + 1, len(words)):
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(own)]
                best = max(best, brute_stretch(same)) if sum(same) >= max(5, len(own) / 2) else best
            if len(own) >= 5 and best >= max(5, len(own) / 2):
                out.add((d, k, best, len(own)))
    return out


def worn(words, n, r):
    """n substitutions, no two side by side."""
    out = list(words)
    for at in r.sample(range(len(out) // 2), n):
        out[2 * at] = f"other{r.random()}"
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SHORT", 16)
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    items = {k: fresh(n) for k, n in enumerate([3, 5, 6, 7, 9, 10, 12, 15, 16, 20, 30, 45])}
    docs, n = {}, 0
    for k, own in items.items():
        for share in (0, 0, 0.1, 0.15, 0.3):
            part = own[: max(1, int(len(own) * r.choice((0.4, 0.7, 1))))] if share == 0 else worn(own, int(share * len(own)), r)
            docs[n] = " ".join(fresh(r.randint(0, 20)) + part + fresh(r.randint(0, 20)))
            n += 1
    docs |= {n: None, n + 1: "", n + 2: " ".join(" ".join(o) for o in items.values())}
    items = {k: " ".join(o) for k, o in items.items()}
    got = D.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    rows = {(x.doc_id, *t) for x in got.collect() for t in zip(x.leaked_items, x.leaked_matched, x.leaked_tokens)}
    want = brute(docs, items)
    assert rows == want and len(want) > 35


@pytest.mark.parametrize("bits", [1 << 28, 1 << 9])
def test_a_full_filter_finds_the_same(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "MOST_BITS", bits)
    fresh = lambda i, n: " ".join(f"w{random.Random(i * 1000 + j).randrange(10**6)}" for j in range(n))
    bench = spark.createDataFrame([(i, fresh(i, 40)) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, fresh(100 + i, 10) + " " + fresh(i, 40)) for i in range(30)] * 3, "doc_id long, text string")
    assert sorted((r.doc_id, *r.leaked_items) for r in D.leaks(docs, bench).collect()) == sorted([(i, i) for i in range(30)] * 3)
    assert D.clean(docs, bench).count() == 0


def test_how_much_of_what_was_reworded_has_a_seed():
    """Seeds alone: of items with as many substitutions, at random places, as SIMILARITY allows."""
    r, share = random.Random(5), {}
    for size, gone in ((6, 1), (10, 1), (12, 2), (15, 3), (20, 4), (29, 5), (30, 3), (40, 4), (40, 8), (60, 12)):
        hit = 0
        for _ in range(400):
            own = np.array([r.getrandbits(63) for _ in range(size)], np.uint64)
            other = own.copy()
            for at in r.sample(range(size), gone):
                other[at] = r.getrandbits(63)
            hit += any((D.seeds(own, m) == D.seeds(other, m)).any() for m in D.masks(size))
        share[size, gone] = hit / 400
    print(share)
    assert min(share.values()) >= 0.9 and share[10, 1] == share[6, 1] == 1


def test_a_text_and_an_item_in_a_third_of_all_rows(spark):
    item = " ".join(f"h{i}" for i in range(25))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x " + item)).otherwise(F.concat(F.lit("own text of "), F.col("id"))).alias("text"))
    bench = spark.createDataFrame([(1, item)] * 20 + [(2, "some other item of six words")], "item_id long, text string")
    got = D.leaks(docs, bench).where("size(leaked_items) > 0")
    assert got.count() == 1000 and got.where("size(leaked_items) = 20").count() == 1000
