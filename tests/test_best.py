import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsgraph.operators import best, graph, lexical


@pytest.mark.parametrize("words", [False, True])
def test_best_of_blocks_is_the_best_of_all_with_ties(monkeypatch, words):
    r = np.random.default_rng(3)
    monkeypatch.setattr(best, "CELLS", 50)
    scores = np.round(r.random((300, 4)), 1)  # many ties
    ids = r.permutation(300)
    named = np.array([f"k{i:04d}" for i in ids], object) if words else ids
    kept = best.Best(4, 7)
    for part in kept.blocks(300):
        kept.add(named[part], scores[part], 0)
        assert kept.held <= 4 * 4 * 7 + 50
    got = kept.rows()
    for q in range(4):
        want = sorted(((scores[i, q], named[i]) for i in range(300)), reverse=True)[:7]
        assert sorted(zip(got[2][got[1] == q], got[0][got[1] == q]), reverse=True) == want


def test_a_task_never_holds_scores_of_all_its_rows(spark, monkeypatch):
    """What a task of vector.nearest compares at once doesn't grow with its rows or the questions."""
    seen = []
    kept = best.Best(500, 40)
    assert max(part.stop - part.start for part in kept.blocks(100_000)) * 500 <= best.CELLS
    for part in kept.blocks(20_000):
        kept.add(np.arange(part.start, part.stop), np.tile(np.arange(part.start, part.stop)[:, None] % 97 / 97, (1, 500)))
        seen.append(kept.held)
    assert max(seen) <= 5 * max(500 * 40, best.CELLS) and len(kept.rows()[0]) == 500 * 40


def test_nearest_walk_is_a_beginning_of_all_that_is_reached(spark):
    r = np.random.default_rng(5)
    pairs = {(f"n{a}", f"n{b}") for a, b in r.integers(0, 40, (90, 2)).tolist()} | {("hub", f"n{i}") for i in range(40)} | {("n1", "hub")}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    starts = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "hub"), ("c", "n3"), ("d", "alone")], "start string, node string")
    every = {}
    for row in graph.reach(edges, starts, 4, include_start=True).collect():
        every.setdefault(row.start, []).append((row.hop, row.node))
    for limit in (1, 3, 10, 100):
        got = {}
        for row in graph.nearest(edges, starts, 4, limit).collect():
            got.setdefault(row.start, []).append((row.hop, row.node))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:limit] for k, v in every.items()}


def test_a_walk_stops_at_a_hub(spark):
    """A hub of many neighbours costs `limit` rows a start, and what is behind them isn't walked."""
    edges = spark.range(3000).selectExpr("'hub' src", "concat('n', id) dst").union(spark.range(3000).selectExpr("concat('n', id) src", "concat('m', id) dst"))
    starts = spark.createDataFrame([("hub",)], "start string")
    assert graph.nearest(edges, starts, 4, 20).count() == 20
    assert graph.walk(edges, starts, 4, 20).count() == 20


def test_search_sends_no_pairs_of_question_and_document(spark):
    """Where every document has every question's words, a search still gives each task's best alone to the shuffle."""
    from opsgraph.operators import lexical

    docs = spark.range(4000).selectExpr("id", "concat('alpha beta word', id % 7) text").repartition(3)
    asked = spark.createDataFrame([(i, "alpha beta alpha" if i % 2 else "beta word3") for i in range(20)], "question_id long, text string")
    found = lexical.search(lexical.index(docs), asked, top=5)
    got = found.collect()
    assert len(got) == 100 and {r.id for r in got if r.question_id % 2} == set(range(3995, 4000))
    assert {r.id % 7 for r in got if not r.question_id % 2} == {3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_a_change_to_a_hub_is_not_copied_to_all_it_supports(spark):
    """A hub supports 2,000 items, two of which have an incident: rows follow the incidents, not the hub's edges."""
    from opsgraph.operators import tickets
    from opsgraph.plans import lineage

    edges = spark.range(2000).selectExpr("'hub' src", "concat('i', id) dst").union(spark.range(2000).selectExpr("concat('i', id) src", "concat('o', id) dst"))
    at = "timestamp_ntz'2024-01-02 00:00:00'"
    changes = spark.range(50).selectExpr("concat('c', id) number", "'hub' ci_key", f"{at} actual_end", "cast(null as string) raised_after_incident")
    incidents = spark.createDataFrame([("a", "i1"), ("b", "o2"), ("c", "elsewhere")], "number string, ci_key string").selectExpr("*", f"{at} + interval 1 hour opened_at")
    written, real = [], lineage.cut

    def count(df, *more):
        out = real(df, *more)
        written.append((out.columns, out.count()))
        return out

    for module in (tickets, tickets.reach.__globals__, tickets.path_counts.__globals__):
        (module if isinstance(module, dict) else vars(module))["cut"] = count
    try:
        for paths in (False, True):
            got = tickets.preceding_changes(incidents, changes, edges=edges, paths=paths).collect()
            assert sorted((r.incident, r.minutes) for r in got) == [("a", 60)] * 50 + [("b", 60)] * 50
    finally:
        for module in (tickets, tickets.reach.__globals__, tickets.path_counts.__globals__):
            (module if isinstance(module, dict) else vars(module))["cut"] = real
    assert max(n for columns, n in written if "start" in columns) <= 3


def test_shared_reach_is_what_trails_reach(spark):
    from pyspark.sql import functions as F

    from opsgraph.operators import paths

    r = np.random.default_rng(8)
    for size, n in ((12, 15), (12, 25), (6, 30)):
        rows = {(f"g{a}", f"m{b}") for a, b in zip(r.integers(0, size * 2, n).tolist(), r.integers(0, size, n).tolist())}
        df = spark.createDataFrame(sorted(rows), "group string, member string")
        e = df.select(F.col("group").alias("src"), F.col("member").alias("dst"), F.lit("").alias("kind"))
        listed = paths.trail_reach(e, e.select(F.col("dst").alias("start")), 4, "kind").groupBy("start").agg(F.count("*").alias("n"), F.bool_or(F.col("node") == F.col("start")).alias("closed"))
        assert sorted(map(tuple, paths.shared_reach(df).collect())) == sorted(map(tuple, listed.collect()))


def test_shared_reach_walks_dense_parts_once(spark, monkeypatch):
    from opsgraph.operators import paths

    written, real = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: written.append(real(df)) or written[-1])
    df = spark.range(3000).selectExpr("concat('g', id div 10) group", "concat('m', id % 30) member").union(spark.range(300).selectExpr("concat('g', id) group", "'m0' member"))
    got = paths.shared_reach(df).collect()
    assert {tuple(r)[1:] for r in got} == {(329 + 1, True)} and len(got) == 30
    # Four different sets of what is met: of m0, and of the members of the three kinds of groups; not one for each of 30 members.
    assert max(w.count() for w in written if "group" in w.columns and "name" not in w.columns) == 4 * 300


def trails(rows):
    """(n, closed) of each member of (group, member), by sets."""
    of, by = {}, {}
    for g, m in rows:
        of.setdefault(m, set()).add(g)
        by.setdefault(g, set()).add(m)
    found = {}
    for m, own in of.items():
        two = set().union(*(by[g] for g in own))
        three = set().union(*(of[x] for x in two))
        closed = any(x != m and len(of[x] & own) > 1 for x in two)
        found[m] = (len(three) + len(set().union(*(by[g] for g in three))) - 1 + closed, closed)
    return found


def test_shared_reach_of_dense_parts_has_no_row_for_a_pair(spark, monkeypatch):
    """Two dense parts, one of them in several blocks and shares, a chain and lone groups: the same as by sets, and no table written has as many rows as members meet."""
    from opsgraph.operators import dense, paths

    r = np.random.default_rng(5)
    rows = {(f"a{a}", f"p{b}") for a, b in zip(r.integers(0, 900, 9000).tolist(), r.integers(0, 300, 9000).tolist())}
    rows |= {(f"b{a}", f"q{b}") for a, b in zip(r.integers(0, 400, 700).tolist(), r.integers(0, 200, 700).tolist())}
    rows |= {(f"c{i}", f"r{i + k}") for i in range(40) for k in (0, 1)} | {(f"d{i}", f"s{i}") for i in range(20)} | {("hub", f"p{i}") for i in range(300)}
    df = spark.createDataFrame(sorted(rows), "group string, member string").repartition(3)
    written, real = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: written.append(real(df)) or written[-1])
    for name, value in (("WAYS", 0), ("BYTES", 1e6)):
        monkeypatch.setattr(paths, name, value)
    assert {x.start: (x.n, x.closed) for x in paths.shared_reach(df).collect()} == trails(rows)
    assert max(w.count() for w in written) <= len(rows)
    assert paths.shared_reach(df.where("false")).count() == 0
    chains = df.where("group like 'c%' or group like 'd%'")
    monkeypatch.setattr(paths, "MEMBERS", 0)
    assert {x.start: (x.n, x.closed) for x in paths.shared_reach(chains.union(chains)).collect()} == trails({x for x in rows if x[0][0] in "cd"})


def test_walks_as_bits_are_those_of_sets(monkeypatch):
    """Groups that go on in the next batch, single words and blocks, and rows that are folded by themselves."""
    import pyarrow as pa

    from opsgraph.operators import dense

    r = np.random.default_rng(6)
    for links, words, few, size in ((1, 1, 0, 3), (50, 700, 2, 7), (10**6, 10**6, 32, 1000)):
        for name, value in (("LINKS", links), ("WORDS", words), ("FEW", few), ("PIECE", links)):
            monkeypatch.setattr(dense, name, value)
        rows = sorted({(a * 7919 - 5000, b * 104729 - 999) for a, b in zip(r.integers(0, 90, 300).tolist(), r.integers(0, 150, 300).tolist())} | {(-1, b * 104729 - 999) for b in range(100, 150)})
        batches = lambda names, columns: [pa.RecordBatch.from_arrays([c[i : i + size] for c in columns], names=names) for i in range(0, len(columns[0]), size)]
        lists = pa.Table.from_batches(dense.lists(iter(batches(["group", "member"], [pa.array(c) for c in zip(*sorted(rows * 2))])))).combine_chunks().to_batches()[0]
        parts = {x["member"]: x["part"] for b in dense.starred(dense.linked(iter(batches(["first", "members"], lists.columns[1:])))) for x in b.to_pylist()}
        leads = sorted((parts[x["first"]], share, 2, x["group"], x["members"]) for x in lists.to_pylist() for share in (0, 1))
        found = dense.walked(iter(batches(["part", "share", "shares", "group", "members"], [pa.array(c) for c in zip(*leads)])))
        assert sorted((x["member"], (x["n"], x["closed"])) for b in found for x in b.to_pylist()) == sorted(trails(rows).items())


def test_damage_has_one_row_a_start_and_node(spark, monkeypatch):
    """All seeds and fractions walk in one row; what is counted is what walks on each damaged graph find."""
    from opsgraph.operators import experiments

    r = np.random.default_rng(2)
    edges = spark.createDataFrame(sorted({(f"n{a}", f"n{b}") for a, b in r.integers(0, 25, (60, 2)).tolist()}), "src string, dst string").cache()
    starts = edges.select("src").distinct().withColumnRenamed("src", "start")
    seeds, fractions = (1, 2), (0.0, 0.2, 0.5)
    written, real = [], experiments.cut
    monkeypatch.setattr(experiments, "cut", lambda df: written.append(real(df)) or written[-1])
    got = {(x.seed, x.fraction, x.start): (x.found, x.gold) for x in experiments.damage_runs(edges, starts, 3, seeds, fractions).collect()}
    whole = {x.start: x.n for x in graph.reach(edges, starts, 3).groupBy("start").count().withColumnRenamed("count", "n").collect()}
    for seed in seeds:
        for f in fractions:
            left = experiments.damaged(edges, (seed,), (f,))
            found = {x.start: x.n for x in graph.reach(left, starts, 3).groupBy("start").count().withColumnRenamed("count", "n").collect()}
            assert {s: v for (a, b, s), v in got.items() if (a, b) == (seed, f)} == {s: (found.get(s, 0), n) for s, n in whole.items()}
    assert written[1].count() <= edges.count()  # the first frontier: a row an edge, not one for each seed and fraction


def test_gold_of_a_whole_class_is_not_listed(spark):
    from opsgraph.operators import evaluate

    classes = spark.createDataFrame([(i, i % 3 if i < 9 else None) for i in range(12)], "id long, label int")
    asked = classes.where("id in (0, 1, 10)").withColumnRenamed("id", "question_id")
    found = spark.createDataFrame([(0, 3), (0, 4), (0, 11), (10, 1)], "question_id long, id long")
    shared = evaluate.shared_with_class(found, asked, classes)
    assert sorted(map(tuple, shared.collect())) == [(0, 1, 2, 2), (1, 0, 0, 3)]


def test_largest_reach_reads_only_edges_that_pass_on(spark, monkeypatch):
    """Leaves have no edges of their own; edges to them are read for the first hop alone."""
    from opsgraph.operators import paths

    edges = spark.range(400).selectExpr("concat('a', id % 4) src", "concat('leaf', id) dst").union(spark.range(4).selectExpr("'root' src", "concat('a', id) dst"))
    written, real = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: written.append(real(df)) or written[-1])
    assert [tuple(x) for x in paths.largest_reach(edges, 4).collect()] == [("root", 404)]
    assert [w.count() for w in written if w.columns in (["src", "dst"], ["dst", "src"])] == [404, 4]


def test_each_different_term_is_folded_for_itself(spark):
    """However often it occurs: what is folded is counted, 40,000 words of 100 kinds."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def fold(terms: pd.Series) -> pd.Series:
        calls.add(len(terms))
        return terms.str.rstrip("s")

    texts = [(i, " ".join(f"{'aeiou'[j % 5]}{j}{'s' * (i % 2)}" for j in range(50) for _ in range(4))) for i in range(200)]
    idx = lexical.index(spark.createDataFrame(texts, "id long, text string").repartition(4), lexical.tokens, fold)
    got = {r.id: (r.length, list(r.codes), list(r.tfs)) for r in lexical.counted(idx, ["a5", "e1", "none"]).collect()}
    assert got == {i: (200, [0, 1], [4, 4]) for i, _ in texts}
    assert calls.value <= 2 * 100  # for the join's filter and for its key
