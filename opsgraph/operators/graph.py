"""Bounded graph traversal: breadth-first frontiers as joins, pruned by what was reached before.

Edges are (src, dst) and are filtered by the caller first, so predicates on every edge of a path reach
the scan. Each hop is one join on the node and one anti-join with the nodes reached; rows are (start,
node), so many starts walk at once and a node with very many neighbours costs as many rows, not paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opsgraph.functions.folds import let
from opsgraph.plans.lineage import cut


def reach(edges: DataFrame, starts: DataFrame, hops: int, include_start: bool = False, world: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """(start, node, hop) of what is reached from each start in at most `hops` steps, with the least number of steps.

    starts has (start) or (start, node), the latter to begin at nodes other than the start's name. The
    start itself is left out, or with include_start has hop 0. Cycles end at nodes reached before. The
    edges and each hop's frontier are checkpointed, so that no hop computes them again. With world,
    edges and starts have these columns too, and walks stay in their own world. Edges that are different
    ones and written already aren't written again.
    """
    w = list(world)
    first = starts.select(*w, "start", (F.col("node") if "node" in starts.columns else F.col("start")).alias("node")).distinct()
    step = edges.select(*w, F.col("src").alias("node"), F.col("dst"))
    step = step if written else cut(step.distinct())
    seen = frontier = first.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        found = frontier.join(step, [*w, "node"]).select(*w, "start", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen.select(*w, "start", "node"), [*w, "start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen if include_start else seen.where("hop > 0")


def returns(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Starts that a directed cycle of at most `hops` edges leads back to: (start)."""
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    found = reach(edges, starts, hops - 1, include_start=True).join(step, "node")
    return found.where("dst = start").select("start").distinct()


def both_ways(edges: DataFrame, starts: DataFrame, hops: int, include_start: bool = True) -> DataFrame:
    """(start, node, hop, way): what is reached upwards (along the edges) and downwards (against them)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = reach(edges, starts, hops, include_start).withColumn("way", F.when(F.col("hop") == 0, "start").otherwise("up"))
    return up.unionByName(reach(back, starts, hops).withColumn("way", F.lit("down")))


def undirected_reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hop) over edges taken either way; the start itself is left out."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return reach(both, starts, hops)


def oldest_evidence(edges: DataFrame, starts: DataFrame, hops: int, seen: str = "last_discovered") -> DataFrame:
    """(start, node, hops, oldest): for each way's oldest edge date to a node, the least number of steps.

    Grouped by node and date after every hop, so the rows kept grow with distinct dates, not with paths.
    A null date counts as no evidence; a path of nulls alone has a null date.
    """
    step = cut(edges.select(F.col("src").alias("node"), "dst", F.col(seen).alias("_seen")))
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(None).cast(edges.schema[seen].dataType).alias("oldest"))
    found = None
    for hop in range(1, hops + 1):
        frontier = cut(frontier.join(step, "node").select("start", F.col("dst").alias("node"), F.least("oldest", "_seen").alias("oldest")).distinct())
        now = frontier.withColumn("hops", F.lit(hop))
        found = now if found is None else found.unionByName(now)
    return found.groupBy("start", "node", "oldest").agg(F.min("hops").alias("hops"))


def degree(edges: DataFrame, a: str = "parent", b: str = "child") -> DataFrame:
    """(key, degree): every end of every edge counts, parallel edges too."""
    return edges.select(F.explode(F.array(a, b)).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


#: Names of at most so many characters in all are one automaton, which every task gets.
AUTOMATON = 4_000_000
#: More names and texts meet in the last so many characters of the name.
ENDING = 8
#: If they end in no more different characters than these, only such places of a text are looked at.
LAST = 64


def named_in(questions: DataFrame, names: DataFrame, folded: bool = True) -> DataFrame:
    """(question_id, key, name): every name (not empty) that a question's text holds; folded: letter case aside.

    Names of AUTOMATON characters in all are looked for by one automaton, in one scan of a text, however
    many names end alike. More of them meet texts in an equality join, see `_named_by_endings`.
    """
    fold = F.lower if folded else F.col
    known = names.where(F.length("name") > 0).select("key", "name", fold("name").alias("_name"))
    asked = questions.select("question_id", fold("text").alias("_text"))
    size = known.agg(F.sum(F.length("name"))).first()[0] or 0
    if size > AUTOMATON:
        return _named_by_endings(asked, known)
    sent = questions.sparkSession.sparkContext.broadcast([c.to_pylist() for c in known.toArrow().columns])
    types = {f.name: f.dataType for f in [*asked.schema, *known.schema]}
    schema, key_type = f"question_id {types['question_id'].simpleString()}, key {types['key'].simpleString()}, name string", to_arrow_type(types["key"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        keys, names_, looked_for = sent.value
        for i, name in enumerate(looked_for):
            automaton.add_word(name, [*automaton.get(name, []), i])
        automaton.make_automaton()
        for batch in batches if len(automaton) else ():
            at, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = {k for _, held in automaton.iter(text or "") for k in held}
                at += [i] * len(found)
                of += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([keys[k] for k in of], key_type), pa.array([names_[k] for k in of], pa.string())], names=["question_id", "key", "name"])

    return asked.where("_text is not null").mapInArrow(scan, schema).distinct()


def _named_by_endings(asked: DataFrame, known: DataFrame) -> DataFrame:
    """named_in for any number of names.

    A name's ending, the part in which names of one kind differ, is the key of an equality join with the
    pieces of that length of a text; whether the whole name is there is looked at after. Pieces that no
    name can end in, for their last character or their length, are left out before the join.
    """
    known = known.withColumn("_end", F.substring("_name", F.greatest(F.lit(1), F.length("_name") - ENDING + 1), F.lit(ENDING)))
    kinds = known.select(F.length("_end").alias("n"), F.substring("_end", -1, 1).alias("c")).distinct().groupBy("n").agg(F.slice(F.array_sort(F.collect_set("c")), 1, LAST + 1).alias("c")).collect()  # ENDING rows at most

    def pieces(chars: Column, n: int, last: list[str]) -> Column:
        """The stretches of n characters; a place in an array is found at once, in a text only from its start."""
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars))), lambda i: (i >= n) & (i <= F.size(chars)))
        if len(last) <= LAST:
            ends = F.filter(ends, lambda i: F.get(chars, i - 1).isin(last))
        return F.transform(ends, lambda i: F.array_join(F.slice(chars, i - n + 1, n), ""))

    none = F.array().cast("array<string>")
    every = let(F.split("_text", ""), lambda chars: F.array_distinct(F.concat(*(pieces(chars, r.n, r.c) for r in kinds)))) if kinds else none
    # Alike pieces shuffle so small that one side would be broadcast, and every task would hold all of them.
    found = asked.select("question_id", "_text", F.explode(every).alias("_end")).join(known.hint("merge"), "_end").where(F.contains("_text", F.col("_name")))
    return found.select("question_id", "key", "name").distinct()


def entry_points(questions: DataFrame, names: DataFrame, top: int = 3) -> DataFrame:
    """(question_id, key, name, place): the longest names that a question's text holds, letter case aside; equal lengths by key."""
    by = Window.partitionBy("question_id").orderBy(F.length("name").desc(), "key")
    return named_in(questions, names).withColumn("place", F.row_number().over(by)).where(F.col("place") <= top).select("question_id", "key", "name", "place")


def seeds(mentions: DataFrame, items: DataFrame, incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """(start, node): items that named records stand for. Items are themselves, incidents and changes their item; other records none."""
    named = mentions.select(F.col("record_id").alias("start"))
    own = named.join(items.select(F.col("key").alias("start")), "start", "left_semi").select("start", F.col("start").alias("node"))
    link = lambda df: named.join(df.where("ci_key is not null").select(F.col("number").alias("start"), F.col("ci_key").alias("node")), "start")
    return own.unionByName(link(incidents)).unionByName(link(changes)).distinct()


def nearest(edges: DataFrame, starts: DataFrame, hops: int, limit: int) -> DataFrame:
    """(start, node, hop) as reach gives it, start included, but of each start only the nearest `limit` nodes; of nodes equally near the least names.

    A start that has them walks no further, so it never holds `limit` nodes before a hop, and of a
    node's neighbours the 2 x `limit` least names are all that can count: fewer than `limit` of them are
    known, and where as many are new, the start is done. What a start costs is so bounded, whatever a node's edges.
    """
    by = Window.partitionBy("node").orderBy("dst")
    step = edges.select(F.col("src").alias("node"), F.col("dst")).distinct().withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= 2 * limit)
    step = cut(step.drop("_n"))
    first = starts.select("start", (F.col("node") if "node" in starts.columns else F.col("start")).alias("node")).distinct()
    place = F.row_number().over(Window.partitionBy("start").orderBy("node"))
    seen = frontier = cut(first.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n").withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        open_ = seen.groupBy("start").agg(F.count("*").alias("_had")).where(F.col("_had") < limit)
        found = frontier.join(step, "node").select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        # A rank bounded by a number alone is filtered before the rows of a start come together; what of it is left after that is exact.
        new = found.withColumn("_n", place).where(F.col("_n") <= limit).join(open_, "start").where(F.col("_n") + F.col("_had") <= limit)
        frontier = cut(new.select("start", "node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def walk(edges: DataFrame, starts: DataFrame, hops: int = 4, limit: int = 80) -> DataFrame:
    """(start, node, hop, way, place): a start's neighbourhood in a fixed order, the nearest first; `limit` of them are the result.

    What is among the nearest both ways is among the nearest of each way that leads to it in as few steps, so each way is bounded.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = nearest(edges, starts, hops, limit).withColumn("way", F.when(F.col("hop") == 0, "start").otherwise("up"))
    found = up.unionByName(nearest(back, starts, hops, limit).where("hop > 0").withColumn("way", F.lit("down")))
    once = found.groupBy("start", "node").agg(F.min(F.struct("hop", "way")).alias("m")).select("start", "node", "m.hop", "m.way")
    by = Window.partitionBy("start").orderBy("hop", "node")
    return once.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)
