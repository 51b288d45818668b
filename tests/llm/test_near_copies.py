"""Near copies by their sets of shingles: what may be left uncompared, and the groups, against plain programs."""

import random

import numpy as np
import pytest

from opsgraph.llm import simhash


def shared(a, b):
    return len(np.intersect1d(a, b, True))


@pytest.mark.parametrize("n", [1, 5, 40, 128, 400, 3000, 120_000])
def test_cells_never_bound_below_what_two_sets_share(n):
    """Of any two sets, also of so many shingles that counts end at 255."""
    rng = np.random.default_rng(n)
    for share in (0.0, 0.5, 0.79, 0.9, 1.0):
        common = rng.integers(0, 2**63, int(n * share), np.uint64)
        both = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common) + extra, np.uint64)])) for extra in (0, n // 9)]
        at = np.array([0, len(both[0]), len(both[0]) + len(both[1])])
        x, y = simhash.cells(np.concatenate(both), at)
        most = (len(both[0]) + len(both[1]) - int(simhash.apart(x, y))) / 2
        assert shared(*both) <= most <= len(both[0]) + len(both[1])
        if n == 400 and share < 0.6:
            assert most < 0.8 / 1.8 * at[-1]


def test_large_texts_at_the_border_equal_brute_force(spark):
    """Texts of 150 to 1,500 words, with as many words changed as bring them just above or just below 0.8."""
    rng = random.Random(11)
    texts = []
    for base in range(6):
        n = rng.choice([150, 400, 1500])
        words = [f"w{base}x{i}" for i in range(n)]
        texts.append(" ".join(words))
        for changed in (n // 60, n // 48, n // 45, n // 43, n // 30):
            other = list(words)
            for i in rng.sample(range(n), changed):
                other[i] = f"y{len(texts)}z{i}"
            texts.append(" ".join(other))
    found = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    alike = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])]
    for a, b in alike:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fingers = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    for a, b in fingers.items():
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    left = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert left == set(root) and 6 < len(left) < len(texts) and len(alike) > 5


def test_a_large_bucket_of_texts_that_are_not_alike_makes_few_pairs(spark, monkeypatch):
    """200 worn copies of a text that isn't there: each could be alike to any by its rarest shingles, few are."""
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(5, 115), 2):
            words[at] = f"y{i}z{at}"
        texts.append(" ".join(words))
    made, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest, **more: made.append(pairs.select("k", "o").distinct().count()) or alike(pairs, *rest, **more))
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    near = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])]
    for a, b in [*near, *((b, a) for a, b in prints.items())]:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert kept == set(root)
    assert sum(made) < 5_000 < len(texts) * (len(texts) - 1) / 2
