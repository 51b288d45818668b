"""Operators on small hand-made tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opsgraph.functions import text
from opsgraph.operators import chunks, evaluate, experiments, fuse, graph, lexical, synth, tickets, vector
from opsgraph.plans import arms, text2sql
from opsgraph.sources import records
from opsgraph.streaming import events


def edges(spark, *pairs):
    return spark.createDataFrame(pairs or [("", "")], "src string, dst string").where("src <> ''")


def starts(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "start string")


def test_reach_ends_on_cycles_and_leaves_the_start_out(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"))
    got = {(r.node, r.hop) for r in graph.reach(e, starts(spark, "a"), 4).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3), ("e", 4)}
    assert {r.start for r in graph.returns(e, starts(spark, "a", "d"), 3).collect()} == {"a"}
    assert graph.returns(e, starts(spark, "a"), 2).count() == 0


def test_reach_of_nothing(spark):
    assert graph.reach(edges(spark), starts(spark, "a"), 3).count() == 0


def test_evidence_keeps_the_oldest_date_of_a_path(spark):
    old, new = datetime(2020, 1, 1), datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", "b", new), ("b", "c", old), ("a", "c", None)], "src string, dst string, last_discovered timestamp_ntz")
    got = {(r.node, r.hops, r.oldest) for r in graph.oldest_evidence(e, starts(spark, "a"), 2).collect()}
    assert got == {("b", 1, new), ("c", 2, old), ("c", 1, None)}


def test_entry_points_take_the_longest_name(spark):
    q = spark.createDataFrame([("q", "is Payments API down?")], "question_id string, text string")
    names = spark.createDataFrame([("1", "payments"), ("2", "payments api"), ("3", "search")], "key string, name string")
    assert [(r.key, r.place) for r in graph.entry_points(q, names).orderBy("place").collect()] == [("2", 1), ("1", 2)]


def test_stems(spark):
    words = {"classes": "class", "ponies": "poni", "pass": "pass", "cats": "cat", "agreed": "agre", "failed": "fail", "running": "runn", "lnx0525s": "lnx0525s", "this": "thi", "the": "the", "bring": "bring"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == words


def test_question_of_stopwords_keeps_them(spark):
    df = spark.createDataFrame([("What is this",), ("what is Lnx0525",)], "t string")
    assert [r[0] for r in df.select(text.query_terms("t")).collect()] == [["what", "is", "this"], ["lnx0525"]]


def test_bm25_finds_identifiers_and_counts_repeats(spark):
    docs = spark.createDataFrame([(1, "disk full on lnx0525"), (2, "disk slow"), (3, "network down"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(1, "lnx0525"), (2, "disk"), (3, "disk disk")], "question_id long, text string")
    got = lexical.search(lexical.index(docs), q).collect()
    assert [r.id for r in got if r.question_id == 1] == [1]
    one, two = ({r.id: r.score for r in got if r.question_id == k} for k in (2, 3))
    assert {k: round(2 * v, 6) for k, v in one.items()} == {k: round(v, 6) for k, v in two.items()}


def test_fusion_counts_an_id_once_and_joins_both(spark):
    kind = "question_id long, id long, place int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3)], kind)
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], kind)
    got = fuse.reciprocal_ranks([a, b]).orderBy("place").collect()
    assert [r.id for r in got] == [11, 10, 12]
    assert got[1].score == pytest.approx(1 / 61, abs=1e-8)


def test_packing_passes_over_what_is_too_large(spark):
    rows = [("q", 1, 10, 2000), ("q", 2, 11, 1500), ("q", 3, 12, 900), ("q", 4, 13, 200), ("r", 1, 14, 9000)]
    got = {r.q: (r.pieces, r.tokens) for r in fuse.packed(spark.createDataFrame(rows, "q string, place int, id long, tokens int"), "q").collect()}
    assert got == {"q": ([10, 12], 2900), "r": ([], 0)}


def test_control_ignores_the_question(spark):
    docs = spark.range(100).select("id")
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    got = fuse.control(docs, q, top=5).collect()
    assert {r.id for r in got if r.question_id == 1} == {r.id for r in got if r.question_id == 2}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(50, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    got = vector.nearest(df, df.where("id < 3").select(F.col("id").alias("question_id"), "embedding"), 5)
    for q in range(3):
        want = sorted(range(50), key=lambda i: (-round(float(v[i].astype(float) @ v[q].astype(float)), 9), -i))[:5]
        assert [r.id for r in got.where(f"question_id = {q}").orderBy("place").collect()] == want
    assert vector.nearest(df, df.where("id < 0").select(F.col("id").alias("question_id"), "embedding")).count() == 0


def test_vectors_of_another_corpus_are_refused(spark):
    with pytest.raises(ValueError, match="another corpus"):
        vector.checked(spark.range(3), spark.range(1, 4))


def test_sign_test():
    assert evaluate.sign_test(6, 0) == pytest.approx(2 / 64)
    assert evaluate.sign_test(0, 0) == 1.0
    assert evaluate.sign_test(3, 3) == 1.0


def test_sign_test_column(spark):
    cases = [(6, 0), (3, 3), (0, 0), (9, 2), (20, 35)]
    df = spark.createDataFrame(cases, "w long, l long").select(evaluate.sign_test_column(F.col("w"), F.col("l")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([evaluate.sign_test(*c) for c in cases])


def test_sign_test_column_of_thousands_of_questions(spark):
    """Where neither the binomial coefficients nor 2 ** n are numbers of 64 bits any more."""
    cases = [(168, 294), (600, 600), (590, 640), (640, 590), (1100, 1250), (0, 1500), (5000, 5150)]
    df = spark.createDataFrame(cases, "w long, l long").select("w", "l", evaluate.sign_test_column(F.col("w"), F.col("l")).alias("p")).collect()
    assert [r.p for r in df] == pytest.approx([evaluate.sign_test(r.w, r.l) for r in df], rel=1e-9)
    assert 0.1 < df[2].p < 0.2 and 0.001 < df[4].p < 0.01


def scored(spark, n_gold, retrieved, error=None, expect_empty=False):
    asked = spark.createDataFrame([("a", 1, "k", False, True, expect_empty, error, 10)], "arm string, question_id long, kind string, holdout boolean, gradable boolean, expect_empty boolean, error string, tokens long")
    got = spark.createDataFrame([("a", 1, i, p) for p, i in enumerate(retrieved, 1)], "arm string, question_id long, id long, place int")
    gold = spark.createDataFrame([(1, i) for i in range(n_gold)], "question_id long, id long")
    return evaluate.scored(asked, got, gold, 1000).first()


def test_scores_at_the_ceiling(spark):
    r = scored(spark, 60, [99, 3, 3])
    assert (r.recall, r.mrr, r.precision, r.enumeration) == (pytest.approx(1 / 60), 0.5, pytest.approx(1 / 3), False)
    r = scored(spark, 61, [1])
    assert (r.recall, r.mrr, r.precision, r.enumeration, r.chance_precision) == (None, None, 1.0, True, pytest.approx(0.061))


def test_what_failed_has_no_scores(spark):
    r = scored(spark, 5, [], error="timeout")
    assert (r.failed, r.recall, r.precision) == (True, None, None)
    assert scored(spark, 0, [], expect_empty=True).precision == 1.0
    assert scored(spark, 0, [4], expect_empty=True).precision == 0.0
    assert scored(spark, 5, []).recall == 0.0


def test_an_empty_gold_set_is_an_error(spark):
    with pytest.raises(Exception, match="gold set is empty"):
        scored(spark, 0, [1])


def test_verdict_words_in_order(spark):
    rows = [("a", 1, "CORRECT", "CORRECT", 1.0), ("a", 2, "WRONG, not refused", "Refused", 0.0), ("a", 3, "hm", "hm", 0.0)]
    r = evaluate.verdicts(spark.createDataFrame(rows, "arm string, question_id long, reply string, again string, recall double")).first()
    assert (r.correct, r.wrong, r.refused, r.unparsed, r.flipped, r.agrees) == (1, 1, 0, 1, 1, 3)


def test_damage_only_grows(spark):
    e = edges(spark, *[(f"a{i}", f"b{i}") for i in range(300)])
    left = {f: {(r.src, r.dst) for r in experiments.damaged(e, (1,), (0.0, 0.2, 0.6)).where(f"fraction = {f}").collect()} for f in (0.0, 0.2, 0.6)}
    assert len(left[0.0]) == 300 and left[0.6] < left[0.2] < left[0.0]
    assert experiments.dropped_exactly(e, 3, 0.25).count() == 225


def test_interval_join_edges(spark):
    at = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    inc = spark.createDataFrame([("I1", "c", at(30)), ("I2", "c", at(6)), ("I3", None, at(6))], "number string, ci_key string, opened_at timestamp_ntz")
    chg = spark.createDataFrame([("C1", "c", at(6), None), ("C2", "c", at(7), None), ("C3", "c", at(7), "I2"), ("C4", "c", None, None)], "number string, ci_key string, actual_end timestamp_ntz, raised_after_incident string")
    got = {(r.incident, r.change, r.minutes) for r in tickets.preceding_changes(inc, chg).collect()}
    assert got == {("I1", "C2", 23 * 60)}


def test_sections_keep_their_numbers(spark):
    a = spark.createDataFrame([("KB1", "Intro long enough to stay here\n## A\nx\n## Long one\nwith words in it")], "number string, text string")
    assert [r.chunk_id for r in chunks.sections(a).orderBy("chunk_id").collect()] == ["KB1:s0", "KB1:s2"]


def test_size_report_takes_the_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 10)], "strategy string, tokens int")
    r = chunks.size_report(df).first()
    assert (r.n, r.total, r.mean, r.median, r.largest) == (4, 16, 4.0, 3, 10)


def test_upsert_is_idempotent_and_last_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    once = records.upserted(old, new, "k", "v")
    assert {(r.k, r.v) for r in once.collect()} == {("a", 1), ("b", 3), ("c", 1)}
    assert records.digest(records.upserted(once, new, "k", "v")) == records.digest(once)
    assert records.missing(old, new, "k").count() == 1
    with pytest.raises(ValueError, match="1 rows"):
        records.complete(old, new, "k")


def test_records_round_trip(spark, tmp_path):
    good = '{"number":"INC1","priority":2,"opened_at":"2026-08-01T10:00:00+00:00","work_notes":[["2026-08-01T11:00:00+00:00","bo","looked"]]}\n\n'
    (tmp_path / "incidents.jsonl").write_text(good)
    df = records.read(spark, str(tmp_path), "incidents")
    r = df.first()
    assert df.count() == 1 and r.work_notes[0].text == "looked" and r.ci_key is None
    n, seal = records.write(df, str(tmp_path / "out"))
    assert n == 1 and records.digest(df)[1] == seal
    assert records.bad_lines(spark, str(tmp_path), "incidents").count() == 0


def test_lines_that_are_not_json_are_seen(spark, tmp_path):
    (tmp_path / "problems.jsonl").write_text('{"number":"P1"}\n\nnot json\n{"number":"P2"}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        records.read(spark, str(tmp_path), "problems").collect()
    assert [r.line for r in records.bad_lines(spark, str(tmp_path), "problems").collect()] == ["not json"]
    assert sorted(str(r.number) for r in records.read(spark, str(tmp_path), "problems", "PERMISSIVE").collect()) == ["None", "P1", "P2"]


def test_upsert_without_an_order_takes_the_greatest_row(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 2, "b"), ("a", 2, "c"), ("a", 1, "z")], "k string, v int, t string")
    assert [tuple(r) for r in records.upserted(old, new.repartition(3), "k").collect()] == [("a", 2, "c")]


def test_items_are_reconciled_by_key_then_name(spark):
    items = spark.createDataFrame([("a", "A", "c"), ("b", "B", "c"), ("d", "D", "c")], "key string, name string, sys_class_name string")
    there = spark.createDataFrame([("1", "a", "old name", "c"), ("2", None, "B", "c"), ("3", None, "B", "c"), ("4", None, "D", "other")], "sys_id string, key string, name string, sys_class_name string")
    got = {r.key: r for r in records.reconciled(items, there).collect()}
    assert (got["a"].sys_id, got["a"].is_new, got["b"].sys_id, got["b"].is_new, got["d"].is_new) == ("1", False, "2", False, True)
    again = records.reconciled(items, items.join(records.reconciled(items, there), "key").select("sys_id", "key", "name", "sys_class_name"))
    assert {r.key: r.sys_id for r in again.collect()} == {k: r.sys_id for k, r in got.items()} and again.where("is_new").count() == 0


def test_edges_are_linked_by_type_and_known_ends(spark):
    rels = spark.createDataFrame([("a", "b", "Runs on"), ("a", "b", "Runs on"), ("a", "gone", "Runs on")], "parent_key string, child_key string, type_name string")
    types = spark.createDataFrame([("Runs on", "t1")], "name string, sys_id string")
    ids = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, sys_id string")
    assert [tuple(r) for r in records.linked(rels, types, ids).collect()] == [("1", "2", "t1")]
    with pytest.raises(ValueError, match="Runs on"):
        records.linked(rels, types.limit(0), ids)


def test_platform_rows_make_the_smaller_graph(spark):
    two = "struct<value:string,display_value:string>"
    cis = spark.createDataFrame([("1", ("web", "web"), ("c", "C")), ("2", ("db", "db"), ("c", "C"))], f"sys_id string, name {two}, sys_class_name {two}")
    rels = spark.createDataFrame([(("1", "web"), ("2", "db"), ("x", "Runs on")), (("1", "web"), ("9", "gone"), ("x", "Runs on"))], f"parent {two}, child {two}, type {two}")
    tickets_ = spark.createDataFrame([(("n1", "INC1"), ("1", "web")), (("n2", "INC2"), ("", "")), (("n3", "INC3"), ("9", "gone"))], f"number {two}, cmdb_ci {two}")
    g = records.platform_graph(cis, rels, tickets_, tickets_)
    assert {k: v.count() for k, v in g.items()} == {"items": 2, "supports": 1, "affects": 1, "changes": 1}
    assert tuple(g["supports"].first()) == ("2", "1", "Runs on")


def test_column_dictionary(spark):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("dict_t")
    assert [tuple(r) for r in records.dictionary(spark, ["dict_t"]).collect()] == [("dict_t", 1, "a", "int", True), ("dict_t", 2, "b", "string", True)]


def test_unknown_names_are_refused(spark):
    dim = spark.createDataFrame([("Runs on", "1")], "name string, sys_id string")
    rows = spark.createDataFrame([("Runs on",), ("Eats",)], "type_name string")
    with pytest.raises(ValueError, match="Eats"):
        records.resolved(rows, dim, "type_name")


BAD = """drop table x; select 1; select 2 ;; with a as (select 1) insert into t select * from a; explain select 1; select * from parquet.`/x`; select * from json . `/x`; set x = 1; cache table t; create view v as select 1
select a from t where a in (select b from csv.`/x`); select (select max(a) from parquet.`/x`); with c as (select * from orc.`/x`) select 1; from t insert into u select *; select reflect('java.lang.System', 'exit', '1'); select a, upper(java_method('a', 'b')) from t; select * from read_files('/x')
with recursive r as (select 1 as n union all select n + 1 from r) select * from r; with recursive r max recursion level 500 as (select 1 as n union all select n + 1 from r) select n from r; selec 1; refresh table t; use db; load data inpath '/x' into table t; add jar '/x'; describe t; """


@pytest.mark.parametrize("bad", [q for line in BAD.splitlines() for q in line.replace("1; select 2 ;;", "1\x00 select 2;").split("; ")])
def test_generated_queries_only_read(spark, bad):
    with pytest.raises(text2sql.Refused):
        text2sql.guarded(spark, bad.replace("\x00", ";"))


GOOD = """select `set`, load from t -- drop table t
select 'insert into t; drop table t' as create, add as delete from (select 1 as add)
select a from t where exists (select 1 from u) union all (values (1)) order by a limit 5 offset 1
with a as (select 1 as x), b as (select * from a) select * from b join a using (x) lateral view explode(array(1)) e as y
select * from t pivot (sum(a) for b in (1, 2))
from t |> where a > 1 |> aggregate count(*) group by b
select count(*) over w from t window w as (order by a)
select * from default.t tablesample (10 percent), lateral (select a + 1)
with recursive r(n) max recursion level 10 as (select 1 union all select n + 1 from r where n < 4) select n from r"""


@pytest.mark.parametrize("good", GOOD.splitlines())
def test_reading_is_allowed_whatever_things_are_called(spark, good):
    assert text2sql.guarded(spark, good) == good


def test_bounded_recursion_is_run(spark):
    q = "with recursive r(n) max recursion level 5 as (select 1 union all select n + 1 from r where n < 4) select n from r"
    assert sorted(r.n for r in text2sql.run(text2sql.planned(spark, q), 30)) == [1, 2, 3, 4]


def test_generated_query_tries_again_with_the_error(spark):
    spark.range(3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).createOrReplaceTempView("things_t")
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return "select nome from things_t" if len(asked) == 1 else "Here:\n```sql\nselect name from things_t where name <> 'drop table' order by name\n```"

    ids, query, error, repeats = text2sql.answered(spark, "all names?", ["things_t"], ask)
    assert (ids, error, repeats) == (["n0", "n1", "n2"], None, 1) and "nome" in asked[1]


def test_synthetic_estate_has_the_measured_shape(spark):
    e = synth.edges(spark, 300, 1).cache()
    inc = synth.incidents(spark, 300, 4000, 1).cache()
    degree = [r.degree for r in graph.degree(e).collect()]
    assert max(degree) > 20 * sorted(degree)[len(degree) // 2]
    assert 0.1 < e.where("datediff(timestamp_ntz'2026-09-01 00:00:00', last_discovered) > 365").count() / e.count() < 0.3
    r = inc.agg(F.avg(F.col("ci_key").isNull().cast("int")), F.avg(F.col("duplicate_of").isNotNull().cast("int")), F.avg((F.col("priority") == 1).cast("int")), F.countDistinct("description") / F.count("*"), F.max("opened_at")).first()
    assert 0.08 < r[0] < 0.3 and 0.05 < r[1] < 0.25 and r[2] < 0.06 and r[3] > 0.95 and r[4] < datetime(2026, 9, 1)
    assert records.digest(inc) == records.digest(synth.incidents(spark, 300, 4000, 1))


def test_stream_counts_like_a_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    got = events.counts(events.once(events.stream(spark, str(tmp_path / "in"))))
    q = got.writeStream.format("memory").queryName("hourly_t").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    late = spark.table("hourly_t").agg(F.sum("n")).first()[0]
    assert late <= spark.read.parquet(str(tmp_path / "in")).count()


def test_stream_upserts(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    q = events.upsert_to(events.stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "ck"))
    q.awaitTermination()
    last = events.upserted(spark, str(tmp_path / "t"), rows.schema)
    want = {r.user_id: r.m for r in rows.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.user_id: r.event_id for r in last.collect()} == want and last.count() == len(want) and last.columns == rows.columns
    before = json.loads((tmp_path / "t" / events.POINTER).read_text())["now"]
    one = rows.where(F.pmod(F.xxhash64("user_id"), F.lit(64)) == int(min(before, key=int)))
    one.withColumn("event_id", F.col("event_id") + 10**6).coalesce(1).write.parquet(str(tmp_path / "in2"))
    events.upsert_to(events.stream(spark, str(tmp_path / "in2")), str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "ck2")).awaitTermination()
    after = json.loads((tmp_path / "t" / events.POINTER).read_text())["now"]
    assert sum(before[p] != after[p] for p in before) == 1  # just the touched one
    assert events.upserted(spark, str(tmp_path / "t"), rows.schema).where("event_id >= 1000000").count() == one.select("user_id").distinct().count()


def test_an_upsert_that_dies_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    schema, folder = events.SCHEMA, str(tmp_path / "t")
    row = lambda i, user, value: (i, datetime(2024, 1, 1), user, "e", value, "{}")
    kept = lambda: {r.user_id: (r.event_id, r.value) for r in events.upserted(spark, folder, schema).collect()}
    run = lambda: events.upsert_to(events.stream(spark, str(tmp_path / "in")), folder, "user_id", "event_id", str(tmp_path / "ck"), 4).awaitTermination()
    assert events.upserted(spark, folder, schema).count() == 0
    spark.createDataFrame([row(1, 1, 1.0), row(2, 2, 2.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    assert kept() == {1: (1, 1.0), 2: (2, 2.0)}
    spark.createDataFrame([row(3, 1, 3.0), row(4, 3, 4.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def dies(*_):
        raise OSError("lost before the switch")

    with monkeypatch.context() as m:
        m.setattr(events, "_point", dies)
        with pytest.raises(Exception, match="lost"):
            run()
    assert kept() == {1: (1, 1.0), 2: (2, 2.0)}
    run()
    run()
    assert kept() == {1: (3, 3.0), 2: (2, 2.0), 3: (4, 4.0)}


def test_index_finds_nine_in_ten(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").select(F.col("id").alias("question_id"), "embedding")
    centres = vector.cells(v, 16)
    index = vector.indexed(v, centres)
    assert index.select("id").distinct().count() == v.count()
    exact, found = vector.nearest(v, q, 10), vector.nearest_in_cells(index, q, centres, 8, 10)
    same = exact.join(found.select("question_id", "id"), ["question_id", "id"]).count()
    assert same / exact.count() >= 0.9


def test_vectors_are_kept_by_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame([(1, "disk full"), (2, None)], "id long, text string")
    made = []

    def make(df):
        made.append(1)
        return vector.embedded(df, vector.hashed_embedder())

    for seal in ("a", "a", "b"):
        assert vector.cached(str(tmp_path), docs, make, seal).count() == 2
    assert len(made) == 2


def test_arms_are_scored_and_broken_ones_fail(spark):
    docs = spark.createDataFrame([(i, f"note{i} about topic{i % 3}") for i in range(30)], "id long, text string")
    asked = spark.createDataFrame([(1, "note5", "lookup", False, True, False), (2, "note7", "lookup", True, True, False), (3, "note9", "lookup", True, True, False)], "question_id long, text string, kind string, holdout boolean, gradable boolean, expect_empty boolean")
    gold = spark.createDataFrame([(1, 5), (2, 7), (3, 9)], "question_id long, id long")

    class Broken:
        name = "broken"

        def retrieve(self, questions):
            raise RuntimeError("no model")

    scores = arms.run([arms.Lexical(docs), arms.Control(docs), arms.Fused([arms.Lexical(docs), arms.Lexical(docs, stemmed=True)]), Broken()], asked, gold, docs).cache()
    by = {r.arm: r for r in evaluate.by_arm(scores).collect()}
    assert by["bm25"].recall == by["hybrid"].recall == 1.0 and by["broken"].failed == 3 and by["broken"].recall is None
    assert "bm25" in arms.report(scores)


def paged(spark, fails, schema=None, where=None, **options):
    """Rows of a service of 25 records whose pages fail as `fails` has it (offset: times), and what it was asked."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from opsgraph.sources.paged import PagedSource

    asked, fails = [], dict(fails)

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            a, n, query = int(q["sysparm_offset"]), int(q["sysparm_limit"]), q.get("sysparm_query", "")
            asked.append((a, n, query))
            if fails.get(a, 0) > 0 and n > 1:
                fails[a] -= 1
                self.send_error(500)
                return
            rows = [f"INC{i}" for i in range(25)]
            if "numberIN" in query:
                rows = [r for r in rows if r in query.partition("numberIN")[2].split(",")]
            self.send_response(200)
            self.send_header("X-Total-Count", str(len(rows)))
            self.end_headers()
            self.wfile.write(json.dumps({"result": [{"number": r, "short_description": ""} for r in rows[a : a + n]]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    try:
        df = spark.read.format("paged").options(url=f"http://127.0.0.1:{server.server_port}/x", page="10", **options)
        df = (df.schema(schema) if schema else df).load()
        return (df.where(where) if where else df).collect(), asked
    finally:
        server.shutdown()


def test_paged_source_reads_all_pages(spark):
    got, asked = paged(spark, {10: 1}, total="25")
    assert {r.number for r in got} == {f"INC{i}" for i in range(25)} and got[0].short_description is None and len(asked) == 4


def test_paged_source_goes_on_where_it_was(spark):
    got, asked = paged(spark, {}, start="20")
    assert {r.number for r in got} == {f"INC{i}" for i in range(20, 25)} and asked[0][1] == 1


def test_a_failing_page_is_never_lost_unseen(spark):
    with pytest.raises(Exception, match="500"):
        paged(spark, {10: 9}, attempts="2")
    got, _ = paged(spark, {10: 9}, "number string, _error string", attempts="2")
    assert len(got) == 16 and [r._error[:3] for r in got if r._error] == ["10:"]


def test_paged_source_pushes_filters(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got, asked = paged(spark, {}, where="number in ('INC3', 'INC24', 'INC99')", pushdown="true")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {r.number for r in got} == {"INC3", "INC24"} and all("numberININC24,INC3,INC99" in q for *_, q in asked)


def test_counting_reads_no_page(spark):
    from opsgraph.sources import paged as source

    seen = []
    source_get = source._get
    source._get = lambda url, attempts, **asked: (seen.append(asked), ([], "41"))[1]
    try:
        assert source.count("x", "a=1") == 41 and seen[0]["sysparm_limit"] == 1
    finally:
        source._get = source_get


def test_a_misrouted_incident_is_one_whose_group_lacks_the_domain(spark):
    incidents = spark.createDataFrame([("I1", "c1", "Network Team"), ("I2", "c1", "Storage"), ("I3", "c2", "STORAGE desk"), ("I4", None, "x"), ("I5", "gone", "x")], "number string, ci_key string, assignment_group string")
    items = spark.createDataFrame([("c1", "network"), ("c2", "storage")], "key string, domain string")
    assert {tuple(r) for r in tickets.misrouted(incidents, items).collect()} == {("I2", "Storage")}


def test_changes_on_what_an_item_needs_are_near(spark):
    at = lambda h: datetime(2024, 1, 2, h)
    incidents = spark.createDataFrame([("I1", "svc", at(12))], "number string, ci_key string, opened_at timestamp_ntz")
    changes = spark.createDataFrame([("own", "svc", at(11), None), ("host", "host", at(10), None), ("san", "san", at(9), None), ("far", "rack", at(9), None), ("above", "user", at(9), None), ("late", "host", at(13), None), ("fix", "host", at(9), "I0")], "number string, ci_key string, actual_end timestamp_ntz, raised_after_incident string")
    e = edges(spark, ("host", "svc"), ("san", "host"), ("db", "svc"), ("san", "db"), ("rack", "san"), ("svc", "user"))
    got = {(r.change, r.minutes) for r in tickets.preceding_changes(incidents, changes, edges=e).collect()}
    assert got == {("own", 60), ("host", 120), ("san", 180)}
    assert {r.change for r in tickets.preceding_changes(incidents, changes).collect()} == {"own"}


def test_repeats_come_with_their_articles(spark):
    incidents = spark.createDataFrame([("I2", "I1"), ("I4", "I3"), ("I5", None)], "number string, duplicate_of string")
    problems = spark.createDataFrame([("P1", "restart", ["I1", "I9"]), ("P2", "wait", ["I3"])], "number string, workaround string, incident_numbers array<string>")
    articles = spark.createDataFrame([("K1", "P1"), ("K2", "P1")], "number string, problem_number string")
    got = {(r.number, r.problem, r.article) for r in tickets.seen_before(incidents, problems, articles).collect()}
    assert got == {("I2", "P1", "K1"), ("I2", "P1", "K2"), ("I4", "P2", None)}


def test_notes_that_name_a_neighbour(spark):
    notes = "array<struct<text:string>>"
    incidents = spark.createDataFrame([("I1", "a", [("saw BETA down",)]), ("I2", "a", [("saw GAMMA",)]), ("I3", None, [("BETA",)]), ("I4", "b", [("x",), ("ALPHA",)]), ("I5", "a", None)], f"number string, ci_key string, work_notes {notes}")
    items = spark.createDataFrame([("a", "ALPHA"), ("b", "BETA"), ("c", "GAMMA")], "key string, name string")
    e = spark.createDataFrame([("a", "b")], "parent string, child string")
    assert {r.number for r in tickets.notes_naming_neighbour(incidents, e, items).collect()} == {"I1", "I4"}


def test_edges_pass_by_what_notes_name(spark):
    """A task's memory is that of the pairs named, not of the edges: these are neither sorted nor made distinct."""
    incidents = spark.createDataFrame([("I1", "a", [("saw BETA and BETA",)]), ("I2", "c", [("saw BETA",)]), ("I3", "b", [("ALPHA",)])], "number string, ci_key string, work_notes array<struct<text:string>>")
    items = spark.createDataFrame([("a", "ALPHA"), ("b", "BETA"), ("c", "GAMMA")], "key string, name string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), (None, "b"), ("c", "a")], "parent string, child string")
    got = tickets.notes_naming_neighbour(incidents, e, items)
    assert [tuple(r) for r in got.orderBy("number").collect()] == [("I1",), ("I3",)]
    assert "ShuffledHashJoin [parent" in got._jdf.queryExecution().sparkPlan().toString()


def test_the_graph_arm_returns_what_it_reached(spark):
    e = edges(spark, ("db", "web"), ("web", "shop"), ("san", "db"), ("shop", "web"))
    items = spark.createDataFrame([(k, k, "c", "prd") for k in ("db", "web", "shop", "san")], "key string, name string, cls string, environment string")
    asked = spark.createDataFrame([(1, "what needs WEB"), (2, "nothing named")], "question_id long, text string")
    got = arms.Named(e, items).retrieve(asked).orderBy("place").collect()
    assert [(r.question_id, r.id) for r in got] == [(1, "db"), (1, "shop"), (1, "san")]
    assert got[0].text == "db db is a c in the prd environment, reached from web."


def test_walks_begin_at_what_records_stand_for(spark):
    e = edges(spark, ("db", "web"), ("web", "shop"))
    items = spark.createDataFrame([(k, k, "c", "prd") for k in ("db", "web", "shop")], "key string, name string, cls string, environment string")
    incidents = spark.createDataFrame([("I1", "web"), ("I2", None)], "number string, ci_key string")
    changes = spark.createDataFrame([("C1", "db")], "number string, ci_key string")
    ranked = spark.createDataFrame([(1, "I1"), (1, "P1"), (2, "P1"), (3, "C1"), (3, "I2")], "question_id long, record_id string")
    got = {(r.question_id, r.id, r.hop) for r in arms.walked(ranked, e, items, incidents, changes).collect()}
    assert got == {(1, "web", 0), (1, "db", 1), (1, "shop", 1), (3, "db", 0), (3, "web", 1), (3, "shop", 2)}
    assert arms.walked(ranked, e, items, incidents, changes, top=1).where("question_id = 1").first().id == "web"


def test_percentile_is_the_element_at_the_index(spark):
    import random

    r = random.Random(1)
    data = [(g, v) for g in "abc" for v in ([r.choice((1.0, 2.0, 5.5, r.random() * 100)) for _ in range(200)] if g != "c" else [7.0])] + [("a", None)]
    got = {x.g: x.value for x in evaluate.percentile_at(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    for g in "abc":
        v = sorted(x for k, x in data if k == g and x is not None)
        assert got[g] == v[min(int(len(v) * 0.95), len(v) - 1)]


def test_classes_score_like_listed_gold(spark):
    classes = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label int")
    asked = spark.createDataFrame([("x", q, "k", False, True, False, None, 1, q % 3) for q in range(4)], "arm string, question_id long, kind string, holdout boolean, gradable boolean, expect_empty boolean, error string, tokens long, label int")
    retrieved = spark.createDataFrame([("x", q, (7 * q + 2 * p) % 30, p) for q in range(4) for p in range(1, 9)], "arm string, question_id long, id long, place int")
    gold = asked.join(classes, "label").select("question_id", "id")
    a, b = evaluate.scored(asked, retrieved, gold, 30), evaluate.scored_by_class(asked, retrieved, classes, 30)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_incorrect_is_not_correct(spark):
    rows = spark.createDataFrame([("a", 1, "Incorrect", "INCORRECT.", 1.0), ("a", 2, "correct", "It is CORRECT", 1.0)], "arm string, question_id long, reply string, again string, recall double")
    r = evaluate.verdicts(rows).first()
    assert (r.correct, r.unparsed, r.flipped, r.agrees) == (1, 1, 0, 1)


def test_blocks_of_queries_find_the_same(spark, sf_dir, monkeypatch):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").select(F.col("id").alias("question_id"), "embedding")
    want = sorted(map(tuple, vector.nearest(v, q, 5).collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, vector.nearest(v, q, 5).collect())) == want and len(want) == 50


def test_entry_holds_the_engine_without_the_text_operators():
    """A package that the text operators need is missing: their queries go, the engine's stay."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 79 and out[1] == "False" and out[0] == out[2]


def test_platform_fields_are_all_set_or_none(spark):
    rows = spark.createDataFrame([("I1", "a", "b", "k", 1, datetime(2024, 1, 1), None, None), ("I2", "a", "b", None, 1, datetime(2024, 1, 1), datetime(2024, 1, 2), None)], "number string, short_description string, description string, ci_key string, priority int, opened_at timestamp_ntz, resolved_at timestamp_ntz, close_notes string")
    got = {r.number: r for r in records.platform_incident(rows, spark.createDataFrame([("k", "77")], "key string, sys_id string")).collect()}
    assert (got["I1"].cmdb_ci, got["I1"].state, got["I1"].close_notes, got["I1"].close_code) == ("77", "2", None, None)
    assert (got["I2"].cmdb_ci, got["I2"].state, got["I2"].close_notes) == ("", "6", "Resolved")


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# x\nURL=\"http://a\"\nno line\n KEY = v\n")
    assert records.settings(str(tmp_path / "env")) == {"URL": "http://a", "KEY": "v"}


def test_synthetic_records_hang_together(spark):
    inc = synth.incidents(spark, 100, 1500, 2).cache()
    prb = synth.problems(inc, 2).cache()
    assert prb.count() and prb.where("size(incident_numbers) < 2").count() == 0
    kb = synth.articles(prb)
    assert chunks.sections(kb).count() >= 2 * kb.count()
    c = synth.changes(spark, 100, 700, 2)
    assert 0.05 < c.where("actual_end is null").count() / 700 < 0.25 and tickets.overran(c).count() > 0
    after = synth.changes(spark, 100, 700, 2, incidents_=inc)
    assert after.columns == c.columns and after.drop("raised_after_incident").subtract(c.drop("raised_after_incident")).count() == 0 and after.count() == 700
    raised = after.where("raised_after_incident is not null").join(inc.select(F.col("number").alias("raised_after_incident"), F.col("ci_key").alias("_of"), "opened_at"), "raised_after_incident", "left")
    assert 20 < raised.count() < 150 and raised.where("ci_key = _of and opened_at < planned_start").count() == raised.count()


def test_frozen_hash_sees_a_changed_question(spark):
    kind = "question_id int, text string, kind string, holdout boolean"
    a = evaluate.frozen_hash(spark.createDataFrame([(2, "b", "k", True), (1, "a", "k", False)], kind))
    assert a == evaluate.frozen_hash(spark.createDataFrame([(1, "a", "k", False), (2, "b", "k", True)], kind))
    assert a != evaluate.frozen_hash(spark.createDataFrame([(1, "a!", "k", False), (2, "b", "k", True)], kind))
    gate = evaluate.control_gate(spark.createDataFrame([("gold", True), ("random", False)], "context string, correct boolean")).first()
    assert gate.passes


class Service:
    """Keeps rows in a folder; commits and then times out now and then; may ignore filters."""

    def __init__(self, folder, phantom=False):
        self.folder, self.phantom = str(folder), phantom

    def send(self, rows):
        import os

        for r in rows:
            with open(f"{self.folder}/{r['number']}", "a") as f:
                f.write("x")
        mark = f"{self.folder}/.fail-{rows[0]['number']}"
        if not os.path.exists(mark) and len(rows) > 3:
            open(mark, "w").close()
            for r in rows[len(rows) // 2 :]:  # half of them did not get through
                os.remove(f"{self.folder}/{r['number']}")
            raise TimeoutError("committed, then timed out")

    def exists(self, keys):
        import os

        return {"other"} if self.phantom else {k for k in keys if os.path.exists(f"{self.folder}/{k}")}


def test_loading_survives_commits_that_time_out(spark, tmp_path):
    from opsgraph.sources import loader

    rows = spark.range(100).selectExpr("concat('INC', id) number", "id").repartition(3)
    service = Service(tmp_path)
    assert loader.load(rows, "number", service.send, service.exists, batch=20, pause=0.01) == 100
    assert all((tmp_path / f"INC{i}").read_text() == "x" for i in range(100))
    assert loader.load(rows, "number", service.send, service.exists) == 0
    with pytest.raises(Exception, match="ignores the filter"):
        loader.load(rows, "number", service.send, Service(tmp_path, phantom=True).exists)


def test_progress_is_whole_or_as_it_was(tmp_path):
    from opsgraph.sources import loader

    path = str(tmp_path / "p")
    assert loader.progress(path) == {}
    loader.keep_progress(path, incidents=5)
    loader.keep_progress(path, changes=2)
    assert loader.progress(path) == {"incidents": 5, "changes": 2}


def test_registered_functions(spark):
    from opsgraph.functions.register import register

    register(spark)
    r = spark.sql("select approx_tokens('abcdefghi') a, round(bm25_idf(10, 1), 6) b, out_of_hours(timestamp_ntz'2024-01-06 12:00:00') c").first()
    assert (r.a, r.b, r.c) == (2, 1.992430, True)
    assert [x.term for x in spark.sql("select t.term from values ('Disk full on lnx01') v(x), lateral terms(v.x) t order by t.place").collect()] == ["disk", "full", "on", "lnx01"]


def test_partly_wrong_answers_peak(spark):
    rows = [(s, f, n) for s in range(5) for f, n in ((0.0, 0), (0.2, 9), (0.4, 4 if s else 12))]
    r = experiments.peaks(spark.createDataFrame(rows, "seed int, fraction double, short long")).first()
    assert (r.seeds, r.falling, r.falls) == (5, 4, True)


def test_crossing_point(spark):
    rows = [(0.0, "g", 1.0), (0.0, "b", 0.4), (0.2, "g", 0.5), (0.2, "b", 0.4), (0.4, "g", 0.4), (0.4, "b", 0.4)]
    assert experiments.crossing(spark.createDataFrame(rows, "fraction double, arm string, recall double"), "g", "b").first().fraction == 0.4


def test_stem_for_sql_is_the_expression(spark):
    from opsgraph.functions.register import register

    register(spark)
    words = "classes ponies glass cats seed agreed need red planned running sing sings disk99 a is us ings eds thing".split()
    df = spark.createDataFrame([(w,) for w in words], "t string")
    df.createOrReplaceTempView("stem_t")
    assert {tuple(r) for r in spark.sql("select t, stem(t) from stem_t").collect()} == {tuple(r) for r in df.select("t", text.stem(F.col("t"))).collect()}


def test_a_judge_is_asked_twice_and_gated(spark):
    from opsgraph.plans import judge

    def ask(prompt):
        if prompt.startswith("Answer"):
            return "disk" if "disk" in prompt.split("Records:")[1].split("Question:")[0] else judge.REFUSAL
        answer = prompt.rsplit("Answer:", 1)[1]
        return "REFUSED" if judge.REFUSAL in answer else "CORRECT" if "disk" in answer else "WRONG"

    rows = spark.createDataFrame([("bm25", 1, "what failed?", "the disk failed", "disk", 1.0), ("bm25", 2, "what failed?", None, "disk", 0.0), ("vector", 1, "what failed?", "the fan", "disk", 0.0)], "arm string, question_id long, question string, context string, gold_text string, recall double")
    control = spark.createDataFrame([(1, "what failed?", "a disk", "a fan")], "question_id long, question string, gold_text string, random_text string")
    verdicts, gate = judge.judged(rows, control, ask)
    got = {r.arm: (r.graded, r.correct, r.refused, r.flipped, r.agrees) for r in verdicts.collect()}
    assert got == {"bm25": (2, 1, 1, 0, 2), "vector": (1, 0, 1, 0, 1)}
    assert tuple(gate.first()) == (1, 0, True)
    assert judge.judged(rows, control, lambda p: "CORRECT")[1].first().passes is False


def test_report_has_its_sections(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"note{i} about topic{i % 3}") for i in range(80)], "id long, text string")
    asked = spark.createDataFrame([(1, "note5", "lookup", False, True, False), (2, "note7", "lookup", True, True, False), (3, "topic1", "sweep", True, True, False)], "question_id long, text string, kind string, holdout boolean, gradable boolean, expect_empty boolean")
    gold = spark.createDataFrame([(1, 5), (2, 7), (2, 900), *((3, i) for i in range(70))], "question_id long, id long")
    scores = arms.run([arms.Lexical(docs), arms.Control(docs)], asked, gold, docs).cache()
    text_ = arms.report(scores, gold, docs)
    assert all(t in text_ for t in ("held out", "enumerations", "by kind", "reachable", "bm25 against control")) and "0.833" in text_
    arms.kept(scores, str(tmp_path))
    assert spark.read.json(str(tmp_path / "scores")).count() == 6 and spark.read.json(str(tmp_path / "arms")).count() == 2


def test_related_incidents_are_recent_and_alike(spark):
    rows = synth.incidents(spark, 100, 3000, 7).cache()
    assert rows.count() == rows.select("number").distinct().count() == 3000
    named = rows.withColumn("other", F.regexp_extract("description", "Possibly related to (INC[0-9]+)", 1)).where("other <> ''")
    both = named.join(rows.select(F.col("number").alias("other"), F.col("category").alias("c2"), F.col("opened_at").alias("o2")), "other")
    assert 0.15 < named.count() / 3000 < 0.25 and both.count() == named.count() == both.where("category = c2 and o2 <= opened_at").count()
    pairs = rows.where("ci_key is not null").groupBy("ci_key", "category").count()
    assert rows.where("duplicate_of is not null").count() > 100 and pairs.where("count > 1").count() > 200


def test_packing_as_a_table_function(spark):
    from pyspark.errors import AnalysisException

    from opsgraph.functions.register import register

    register(spark)
    rows = [("q", 1, 10, 2000), ("q", 2, 11, 1500), ("q", 3, 12, 900), ("q", 4, 13, None), ("q", 5, 14, 200), ("r", 1, 15, 9000), (None, 1, 16, 3000), (None, 2, 17, 0)]
    spark.createDataFrame(rows, "run string, place int, id long, tokens int").createOrReplaceTempView("to_pack")
    got = spark.sql("select * from pack(table(to_pack) partition by run order by (place), 3000)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("q", 10, 1, 2000), ("q", 12, 2, 2900), (None, 16, 1, 3000), (None, 17, 2, 3000)], key=str)
    assert spark.sql("select * from pack(table(select * from to_pack where false) partition by run order by (place), 10)").count() == 0
    for wrong in ("pack(table(select 1 as run) partition by run, 5)", "pack(table(to_pack) partition by run, 'x')", "pack(1, 5)"):
        with pytest.raises(AnalysisException, match="pack"):
            spark.sql(f"select * from {wrong}").collect()


def test_lost_edges_are_counted_and_come_back(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    lost = e.where("src = 'b'")
    left = experiments.without(e, lost)
    assert left.count() == 2 and sorted(map(tuple, experiments.restored(left, lost, 3).collect())) == sorted(map(tuple, e.collect()))
    with pytest.raises(ValueError, match="3 are left"):
        experiments.without(e, spark.createDataFrame([("x", "y")], e.schema))
    with pytest.raises(ValueError, match="2 edges are back"):
        experiments.restored(left, lost.limit(0), 3)


def test_a_load_goes_on_behind_what_is_there(tmp_path):
    from opsgraph.sources import loader

    path = str(tmp_path / "progress.json")
    assert loader.resume_point(path, "events", 0) == 0 and loader.resume_point(path, "events", 7) == 7
    loader.keep_progress(path, events=20)
    assert loader.resume_point(path, "events", 7) == 20 and loader.resume_point(path, "events", 31) == 31 and loader.resume_point(path, "items", 2) == 2
