"""The stages one after another, against what each should do."""

import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsgraph.llm import decontaminate, pieces, secretscan, simhash, toxicity
from opsgraph.llm.common import table
from tests.llm.test_operators import hard, prose  # noqa: F401  hard is a fixture


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """Small tables whose right results a plain program can give."""
    d = str(tmp_path_factory.mktemp("tables"))
    bench = [(k, " ".join(f"b{k}x{j}" for j in range(20))) for k in range(3)]
    texts = []
    for i in range(300):
        own = " ".join(f"d{i // 3 if i % 3 else i}w{j}" for j in range(60))
        own += " vile rotten filth" if i % 5 == 0 else ""
        own += " " + bench[i % 3][1] if i % 7 == 0 else ""
        own += f" token=abcdefghijkl{i}mnop" if i % 4 == 0 else ""
        texts.append(own if i % 3 != 2 else texts[-1] + f" d{i}")
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_equals_a_plain_program(spark, folder):
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    bench = [r.text.split() for r in table(spark, folder, "benchmark").collect()]
    left = {k: t for k, t in sorted(docs.items()) if "vile" not in t}
    sets = {k: set(zip(*(t.split()[i:] for i in range(5)))) for k, t in left.items()}
    root = {k: k for k in left}
    for a in left:
        for b in left:
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = {k: min(root[a], root[b]) if x in (root[a], root[b]) else x for k, x in root.items()}
    left = {k: t for k, t in left.items() if root[k] == k}
    left = {k: t for k, t in left.items() if not any(" ".join(b) in t for b in bench)}
    left = {k: re.sub(r"token=[A-Za-z0-9+/_.=-]{12,}", "[REDACTED]", t) for k, t in left.items()}
    got = pieces.decode(corpus_pipeline.run(spark, folder)).collect()
    assert {r.doc_id: r.decoded for r in got} == left and 60 < len(left) < 200 and any("[REDACTED]" in t for t in left.values())
    assert all(r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_on_hard_rows(spark, sf_dir, hard):  # noqa: F811
    """Nulls in any column, empty and long texts, repeated rows and keys, names that clash."""
    none = hard.select(*(F.lit(None).cast(t).alias(c) for c, t in hard.dtypes)).limit(1)
    docs = hard.unionByName(none)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert got.count() == (n if name != "near copies" else 8 + 1), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"] and last.count() == n
    assert {(r.doc_id, r.n_pieces, r.piece_ids) for r in last.where("doc_id in (0, 1)").select("doc_id", "n_pieces", F.col("piece_ids").cast("string").alias("piece_ids")).collect()} == {(0, 0, None), (1, 0, "[]")}


def test_stages_without_labels_or_benchmark(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    for name in ("labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).count() == docs.count()


def test_what_stages_drop_is_what_their_operators_find(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, toxicity.learnable(table(spark, folder, "labels")))
    bad = {r.doc_id for r in toxicity.score(docs, model).where(F.col("toxicity") >= toxicity.THRESHOLD).collect()}
    assert {r.doc_id for r in docs.join(corpus_pipeline.drop_toxic(spark, docs, folder), "doc_id", "left_anti").collect()} == bad and bad
    changed = {r.doc_id for r in docs.join(corpus_pipeline.mask_secrets(spark, docs, folder).select("doc_id", F.col("text").alias("after")), "doc_id").where("text <> after").collect()}
    assert changed == {r.doc_id for r in secretscan.find(docs).where("size(secret_spans) > 0").collect()} and changed


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{folder}/benchmark.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found.append(stage(spark, found[-1], folder).cache())
        assert found[-1].columns == columns
    _, safe, single, clean, masked = found
    assert 0.8 * docs.count() <= safe.count() <= docs.count()
    groups = simhash.near_duplicates(single.select("doc_id", "text")).select("component_id").distinct().count()
    assert groups == single.count() < safe.count()
    leaked = {r.doc_id for r in single.collect() if any(b.text in r.text for b in bench.collect())}
    assert leaked.isdisjoint({r.doc_id for r in clean.collect()})
    assert decontaminate.leaks(clean, bench).where("size(leaked_items) > 0").count() == 0
    assert masked.count() == clean.count() and masked.where("text rlike 'AKIA[A-Z0-9]{14}'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, masked, folder)
    back = pieces.decode(last).join(masked.select("doc_id", "text"), "doc_id")
    assert back.count() == masked.count() and back.where("decoded <> text").count() == 0


def test_run_gives_the_same_rows_again(spark, folder):
    a, b = (corpus_pipeline.run(spark, folder).select("doc_id", "piece_ids") for _ in range(2))
    assert a.count() > 0 and a.exceptAll(b).count() == 0


def test_no_shuffle_files_stay_of_what_a_stage_has_done(spark):
    files = lambda: sum("shuffle_" in f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before, texts = files(), [" ".join(f"w{i % 20}x{j}" for j in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 20
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.5)
    assert files() <= before
