"""The two label models against plain expectation-maximisation, and what the classifiers learn from."""

import math
import random

import numpy as np
import pytest

from opsgraph.llm import quality, toxicity
from opsgraph.llm.queries import QUERIES
from tests.llm.test_operators import prose


def test_quality_model_equals_plain_em():
    r = random.Random(1)
    rows = [tuple(r.choice((0, 1, 1, 2)) for _ in range(4)) for _ in range(60)]
    kinds = sorted(set(rows))
    counts = [rows.count(k) for k in kinds]
    q = [0.05 if 0 in k else 0.95 for k in kinds]
    for _ in range(7):
        rate, mass = {}, {c: sum(n * (x if c else 1 - x) for n, x in zip(counts, q)) for c in (0, 1)}
        for c in (0, 1):
            for j in range(4):
                got = [sum(n * (x if c else 1 - x) for k, n, x in zip(kinds, counts, q) if k[j] == v) + 1 for v in range(3)]
                rate[c, j] = [g / sum(got) for g in got]
        share = (mass[1] + 1) / (len(rows) + 2)
        odds = [math.log(share / (1 - share)) + sum(math.log(rate[1, j][v] / rate[0, j][v]) for j, v in enumerate(k)) for k in kinds]
        q = [1 / (1 + math.exp(-o)) for o in odds]
    got, rates, part = quality.label_model(np.array(kinds), np.array(counts, float), 7)
    assert got == pytest.approx(q) and part == pytest.approx(share) and rates[1, 2].tolist() == pytest.approx(rate[1, 2])


def test_toxicity_model_equals_plain_em():
    r = random.Random(2)
    rows = [[float(r.random() < (0.7 if i % 4 == 0 else 0.1)) for _ in range(4)] for i in range(80)]
    for v in rows:
        v[3] = v[0]
    start = [0.9 if sum(v) > 1 else 0.1 for v in rows]
    q, n = list(start), len(rows)
    for step in range(4):
        rate = [[(sum(w * v[j] for w, v in zip(ws, rows)) + 0.05) / (sum(ws) + 0.1) for ws in ([1 - x for x in q], q)] for j in range(4)]
        rest = [[v[j] - (1 - x) * rate[j][0] - x * rate[j][1] for j in range(4)] for v, x in zip(rows, q)]
        if step == 0:
            cov = lambda a, b: sum(e[a] * e[b] for e in rest) / n
            corr = [[cov(a, b) / math.sqrt(cov(a, a) * cov(b, b)) for b in range(4)] for a in range(4)]
            damp = [1 / (1 + sum(corr[a][b] ** 2 for b in range(4) if b != a)) for a in range(4)]
        mean = sum(start) / n
        odds = [math.log(mean / (1 - mean)) + sum(damp[j] * math.log(rate[j][1] / rate[j][0] if v[j] else (1 - rate[j][1]) / (1 - rate[j][0])) for j in range(4)) for v in rows]
        q = [1 / (1 + math.exp(-o)) for o in odds]
    got, rates, said = toxicity.label_model(np.array(rows), np.array(start), 4)
    assert got == pytest.approx(q, abs=1e-4) and rates.tolist() == [pytest.approx(x, rel=1e-4) for x in rate] and said[0, 3] == pytest.approx(1)
    assert damp[0] < 0.6 < damp[1]


def test_few_voters_that_agree_keep_both_classes():
    texts = [prose(i, 30) + (" vile rotten" if i % 5 == 0 else "") for i in range(100)]
    model = toxicity.fit(texts, np.array([float(i % 5 == 0) for i in range(100)]))
    scores = model.scores([prose(900 + i, 30) + (" rotten vile" if i % 2 else "") for i in range(20)])
    assert (scores >= toxicity.THRESHOLD).tolist() == [bool(i % 2) for i in range(20)]


def test_toxic_posteriors_come_from_votes():
    """Labels choose the lexicons; with the same lexicons, other labels change nothing."""
    texts = [prose(i, 30) + (" vile rotten" if i % 5 == 0 else " rotten" if i % 7 == 0 else "") for i in range(300)]
    x = np.array([[w in t.split() for w in ("vile", "rotten")] for t in texts], np.float32)
    q, rates, _ = toxicity.posteriors(texts, x, [(0, True), (1, False)])
    want = np.array([i % 5 == 0 for i in range(300)])
    assert ((q > 0.5) == want).all() and rates[0, 1] > 0.7 > 0.3 > rates[1, 0]


def test_quality_features_are_the_texts_own():
    words, pairs, chars = "ab ab cd", 2, 6
    row, at, value = quality.features([words, "", "x"])
    family = at // quality.BUCKETS
    of = lambda t, f: value[(row == t) & (family == f)]
    assert sorted(of(0, 0)) == pytest.approx([1 / 3, 2 / 3]) and of(0, 1).sum() == pytest.approx(2) and len(of(0, 1)) == 2 * pairs
    assert of(0, 2).sum() == pytest.approx(1) and round(1 / min(of(0, 2))) <= chars
    assert [len(of(1, f)) for f in range(4)] == [0, 0, 0, 1] and [len(of(2, f)) for f in range(4)] == [1, 0, 0, 1]


def test_quality_scores_words_that_no_labeller_measures():
    good, bad = [prose(i, 50) for i in range(200)], [f"{prose(1000 + i, 50)} click subscribe" for i in range(200)]
    model = quality.train(good[:150] + bad[:150], np.array([1.0] * 150 + [0.0] * 150))
    assert np.mean(model.scores(good[150:]) > 0.5) > 0.8 and np.mean(model.scores(bad[150:]) < 0.5) > 0.8


def test_quality_and_toxicity_of_labelled_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, sf_dir).join(labels, "doc_id").collect()
    told = lambda want: np.mean([r.predicted == want for r in rows if r.quality == want])
    assert told(1) > 0.95 and told(0) > 0.6  # 11 bad ones in the smallest tables
    rows = QUERIES["op5_toxicity"](spark, sf_dir).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == 0 for r in rows if not r.toxic]) > 0.95


def test_rows_that_share_a_key_are_learned_from_once(spark):
    data = [(1 if i % 3 else i, f"{prose(i % 20, 20)} {'vile' if i % 2 else ''}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in {d for d, _ in data}], "doc_id long, toxic int")
    assert len(toxicity.learn(docs, labels).scores(["vile"])) == len(quality.learn(docs).scores(["x"])) == 1
