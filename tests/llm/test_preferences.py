"""Conversations paired by their first turns, against brute force and SQL, and on hard rows."""

import random

import duckdb
from pyspark.sql import functions as F

from opsgraph.llm import chat
from opsgraph.llm.queries import ORACLES, QUERIES
from tests.conftest import rows

SCHEMA = "conv_id long, turn long, role string, text string"


def talk(key, *texts):
    return [(key, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]


def found(spark, turns, schema=SCHEMA):
    return {r.conv_id: r for r in chat.pairs(chat.conversations(spark.createDataFrame(turns, schema))).collect()}


def test_pairs_share_the_most_first_turns(spark):
    got = found(spark, talk(1, "q", "a", "r", "b") + talk(2, "q", "a", "r", "other") + talk(3, "q", "quite long") + talk(4, "z", "a") + talk(5, "q", "a", "r", "b"))
    assert {k: r.other for k, r in got.items()} == {1: 2, 2: 1, 3: 1, 4: None, 5: 2}
    assert [t.text for t in got[1].chosen] == [t.text for t in got[2].chosen] == ["q", "a", "r", "other"]
    assert [t.text for t in got[3].chosen] == ["q", "quite long"] and [t.text for t in got[3].rejected] == ["q", "a", "r", "b"]
    assert [t.text for t in got[4].rejected] == ["z", ""]


def forest(seed, n):
    """Conversations that branch off each other, some of them equal."""
    r, out = random.Random(seed), []
    texts = []
    for k in range(n):
        own = list(r.choice(texts))[: r.randint(0, 6)] if texts and r.random() < 0.8 else []
        own += [f"t{r.randrange(40)}" * r.randint(1, 3) for _ in range(r.randint(0, 5))]
        texts.append(own)
        out += talk(3 * k + 1, *own)
    return out


def test_pairs_equal_brute_force(spark):
    turns = forest(4, 120)
    talks = {}
    for k, _, role, text in turns:
        talks.setdefault(k, []).append((role, text))
    talks = {k: t[: max(i for i, x in enumerate(t) if x[0] == "assistant") + 1] for k, t in talks.items() if any(x[0] == "assistant" for x in t)}
    got, paired = found(spark, turns), set()
    assert set(got) == set(talks)
    for k, own in talks.items():
        shared = lambda o: next((i for i, (x, y) in enumerate(zip(own, o)) if x != y), min(len(own), len(o)))
        most = max((shared(o) for o in talks.values() if o != own), default=0)
        if not most:
            assert got[k].other is None
            continue
        group = {j: o for j, o in talks.items() if o[:most] == own[:most]}
        least = {tuple(o): min(j for j, x in group.items() if x == o) for o in group.values()}
        want = max(least.values()) if group[min(group)] == own else min(group)
        paired.add(want)
        said = lambda t: sum(len(x) for who, x in t if who == "assistant")
        a, b = sorted((k, want), key=lambda j: (-said(talks[j]), j))
        assert got[k].other == want and [tuple(t) for t in got[k].chosen] == talks[a] and [tuple(t) for t in got[k].rejected] == talks[b]
    lengths = {r.common_turns for r in chat.preferences(chat.pairs(chat.conversations(spark.createDataFrame(turns, SCHEMA)))).collect()}
    assert len(paired) > 10 and len(lengths) > 4


def test_query_equals_sql_on_branching_conversations(spark, tmp_path):
    extra = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (900, None, None, None), (901, 0, "user", None), (901, 1, "assistant", None), (902, 0, "user", None), (902, 1, "assistant", "z"), (903, 5, "assistant", "late"), (903, 5, "assistant", "late"), (903, 0, "user", "q")]
    extra += talk(904, *["many"] * 3001) + talk(905, *["many"] * 2999, "end")
    spark.createDataFrame(forest(9, 150) + extra, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got, want = QUERIES["op4_preferences"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["op4_preferences"]).df()
    assert rows(got) == rows(want) and got.common_turns.nunique() > 4 and got.common_turns.max() == 2999


def test_hard_conversations(spark):
    got = found(spark, [(1, 0, "user", "q"), (2, 1, "assistant", "late"), (2, 0, "user", "q"), (3, None, None, None), (None, 1, "assistant", "x")])
    assert list(got) == [2] and got[2].other is None and got[2].rejected[-1].text == ""
    assert found(spark, [], SCHEMA) == {}
    turns = spark.range(4000).select(F.col("id").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), t.alias("text")) for i, r, t in ((0, "user", F.lit("same")), (1, "assistant", F.concat(F.lit("a"), F.col("id").cast("string"))))))).alias("x")).select("conv_id", "x.*")
    one = chat.pairs(chat.conversations(turns))
    assert one.count() == 4000 and one.where("other is null").count() == 0 and one.select("other").distinct().count() == 2
    clash = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], [("user", "q")], "p", "c")], f"conv_id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string, chosen_segments string")
    assert chat.preferences(clash.union(clash)).count() == 2 and chat.preferences(clash.limit(0)).count() == 0
