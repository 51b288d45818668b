"""The compressed index against all vectors, the store of vectors, and names by an automaton."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsgraph.operators import ann, graph, vector


def made(spark, n, d, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3), x


@pytest.mark.parametrize("n,d", [(3000, 32), (300, 7), (3, 4)])
def test_shortlist_finds_the_nearest(spark, n, d):
    v, x = made(spark, n, d)
    asked = v.where("id < 5").select(F.col("id").alias("question_id"), "embedding")
    fitted = ann.quantiser(v, sample=1000)
    index = ann.indexed(v.unionByName(spark.createDataFrame([(n, None)], v.schema)), fitted)
    assert index.count() == n and len(index.first().code) == -(-d // ann.WIDTH)
    found, true = ann.nearest(index, v, asked, fitted, 20), vector.nearest(v, asked, 20)
    assert ann.recall(found, true).agg(F.avg("recall")).first()[0] >= 0.9
    scores = {(r.question_id, r.id): r.score for r in true.collect()}
    assert all(r.score == scores[r.question_id, r.id] for r in found.collect() if (r.question_id, r.id) in scores)
    # A shortlist of all is the exact answer.
    assert sorted(map(tuple, ann.nearest(index, v, asked, fitted, 20, n).collect())) == sorted(map(tuple, true.collect()))


def test_codes_are_the_nearest_centres(spark):
    v, x = made(spark, 200, 8)
    fitted = ann.quantiser(v, sample=100)
    codes = fitted.codes(x[:20].astype(float))
    for row, code in zip(fitted.parts(x[:20].astype(float)), codes):
        for part, c, k in zip(row, fitted.centres, code):
            assert k == np.argmin(((c - part) ** 2).sum(1))
    approx = fitted.tables(x[:1].astype(float))[0]
    assert np.isclose(sum(approx[j, k] for j, k in enumerate(codes[3])), sum(fitted.centres[j][k] @ fitted.parts(x[:1].astype(float))[0][j] for j, k in enumerate(codes[3])))


def test_no_vectors_or_questions(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    fitted = ann.quantiser(none)
    asked = none.select(F.col("id").alias("question_id"), "embedding")
    assert ann.nearest(ann.indexed(none, fitted), none, asked, fitted).count() == 0


def test_a_text_is_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    plain = vector.hashed_embedder(8)

    def embed(texts):
        calls.add(len(texts))
        return plain(texts)

    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "id long, text string")
    store = ann.Store(str(tmp_path / "store"), "m")
    assert store.add(docs, embed) == 3 and calls.value == 3
    assert store.add(docs, embed) == 0 and calls.value == 3
    more = docs.unionByName(spark.createDataFrame([(6, "c"), (7, "new")], docs.schema))
    with pytest.raises(ValueError, match="1 texts"):
        store.vectors(more)
    assert store.add(more, embed) == 1 and calls.value == 4
    got = {r.id: r.embedding for r in store.vectors(more).collect()}
    assert len(got) == 7 and got[1] == got[2] and got[3] == got[4] and got[5] == got[6]
    assert np.allclose(got[7], plain(["new"])[0])
    assert ann.Store(str(tmp_path / "store"), "other").missing(docs).count() == 3
    near = vector.nearest(store.vectors(more), store.vectors(more.where("id = 5")).withColumnRenamed("id", "question_id"), 2)
    assert [r.id for r in near.orderBy("place").collect()] == [6, 5]


def test_a_run_that_dies_adds_nothing(spark, tmp_path):
    def fails(texts):
        raise ValueError("no model")

    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    store = ann.Store(str(tmp_path / "store"), "m")
    with pytest.raises(Exception, match="no model"):
        store.add(docs, fails)
    assert store.missing(docs).count() == 1 and store.add(docs, vector.hashed_embedder(4)) == 1


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST", 20)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    dims = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 300, 3))], "k string, v long")
    assert sorted(map(tuple, ann.spread_join(rows, dims, "k").collect())) == sorted(map(tuple, rows.join(dims, "k").collect()))


@pytest.mark.parametrize("size", [0, 4_000_000])
def test_names_by_automaton_or_endings(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "AUTOMATON", size)
    names = spark.createDataFrame([(1, "web-0001"), (2, "b-0001"), (3, "WEB-0001"), (4, ""), (5, None), (6, "x"), (6, "x"), (7, "une é"), (8, "missing")], "key long, name string")
    texts = spark.createDataFrame([("a", "on WEB-0001 and web-0001x"), ("b", "une É"), ("c", None), ("d", "")], "question_id string, text string")
    got = {(r.question_id, r.key) for r in graph.named_in(texts, names).collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("a", 6), ("b", 7)}
    assert {(r.question_id, r.key) for r in graph.named_in(texts, names, folded=False).collect()} == {("a", 1), ("a", 2), ("a", 3), ("a", 6)}
    assert graph.named_in(texts, names.limit(0)).count() == 0


def test_pieces_of_texts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "AUTOMATON", 0)
    names = spark.createDataFrame([(1, "web-0001")], "key long, name string")
    texts = spark.createDataFrame([("a", "on web-0001")], "question_id string, text string")
    found = graph.named_in(texts, names)
    assert "SortMergeJoin [_end" in found._jdf.queryExecution().sparkPlan().toString() and found.count() == 1
