"""Experiments: removing edges, growing the corpus, other chunkings, stems. Nothing is changed in place."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.operators.fuse import seeded_order
from opsgraph.plans.lineage import cut

SEEDS, FRACTIONS = (1, 2, 3), (0.0, 0.1, 0.2, 0.4, 0.6)


def damaged(edges: DataFrame, seeds=SEEDS, fractions=FRACTIONS) -> DataFrame:
    """(seed, fraction, src, dst): what is left when each edge is lost with that chance. The chance is a hash of seed and edge, the same in any engine, and more is lost of what was lost before."""
    drawn = edges.select("src", "dst").distinct().withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), "src", "dst")), 1, 8), 16, 10).cast("double") / 4294967296.0
    left = drawn.withColumn("_d", draw).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).where(F.col("_d") >= F.col("fraction"))
    return left.select("seed", "fraction", "src", "dst")


def damage_runs(edges: DataFrame, starts: DataFrame, hops: int = 4, seeds=SEEDS, fractions=FRACTIONS) -> DataFrame:
    """(seed, fraction, start, found, gold): how many nodes each start reaches on damaged edges, and on whole ones. Starts that reach nothing are left out.

    An edge that a fraction loses is lost by all greater ones, so of a seed it has one level, the number of
    fractions that leave it, and a way has the least of its edges'. All seeds, fractions and starts walk at once, a row a
    (start, node) with the best level of each seed, not a row for each seed and fraction; level 0 is the whole graph.
    """
    own, order = edges.select("src", "dst").distinct(), sorted(fractions)

    def level(seed) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "dst")), 1, 8), 16, 10).cast("double") / 4294967296.0
        return F.size(F.filter(F.array(*map(F.lit, order)), lambda f: f <= draw)).cast("byte")

    n = range(len(seeds))
    step = cut(own.select(F.col("src").alias("node"), "dst", *(level(s).alias(f"e{i}") for i, s in enumerate(seeds))))
    top = F.lit(len(order)).cast("byte")
    frontier = starts.select("start").distinct().select("start", F.col("start").alias("node"), *(top.alias(f"l{i}") for i in n))
    found = frontier
    for hop in range(1, hops + 1):
        came = frontier.join(step, "node").groupBy("start", F.col("dst").alias("node")).agg(*(F.max(F.least(f"l{i}", f"e{i}")).alias(f"c{i}") for i in n))
        had = found.groupBy("start", "node").agg(*(F.max(f"l{i}").alias(f"l{i}") for i in n)) if hop > 1 else found
        better = came.join(had, ["start", "node"], "left")
        new = better.where(reduce(or_, (F.col("l0").isNull(), *(F.col(f"c{i}") > F.col(f"l{i}") for i in n))))
        frontier = cut(new.select("start", "node", *(F.col(f"c{i}").alias(f"l{i}") for i in n)))
        found = found.unionByName(frontier)
    best = found.where("node != start").groupBy("start", "node").agg(*(F.max(f"l{i}").alias(f"l{i}") for i in n))
    counts = best.groupBy("start").agg(F.count("*").alias("gold"), *(F.count_if(F.col(f"l{i}") > k).alias(f"n{i}_{k}") for i in n for k in range(len(order))))
    cells = F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(f).alias("fraction"), F.col(f"n{i}_{k}").alias("found")) for i, s in enumerate(seeds) for k, f in enumerate(order)))
    return counts.select("start", "gold", F.explode(cells).alias("c")).select("c.seed", "c.fraction", "start", "c.found", "gold")


def _outcomes() -> list[Column]:
    found, gold = F.col("found"), F.col("gold")
    return [F.count("*").alias("runs"), F.count_if(found == gold).alias("exact"), F.count_if((found > 0) & (found < gold)).alias("short"), F.count_if(found == 0).alias("empty"), F.round(F.avg(found / gold), 6).alias("recall")]


def damage_sweep(edges: DataFrame, starts: DataFrame, hops: int = 4, seeds=SEEDS, fractions=FRACTIONS) -> DataFrame:
    """(fraction, runs, exact, short, empty, recall): how the sets reached from the starts hold up."""
    return damage_runs(edges, starts, hops, seeds, fractions).groupBy("fraction").agg(*_outcomes())


def recalls(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, recall) of a ranking (question_id, id), for each question that has gold (question_id, id)."""
    sizes = gold.groupBy("question_id").agg(F.count("*").alias("gold"))
    hit = ranking.select("question_id", "id").distinct().join(gold, ["question_id", "id"], "left_semi").groupBy("question_id").agg(F.count("*").alias("hits"))
    return sizes.join(hit, "question_id", "left").fillna(0, ["hits"]).select("question_id", (F.col("hits") / F.col("gold")).alias("recall"))


def dropped_exactly(edges: DataFrame, seed: int, fraction: float) -> DataFrame:
    """edges (src, dst) without just floor(n x fraction) of them, drawn by hash.

    The cut-off is found by counting how many hashes begin alike, so no task ranks all edges.
    """
    e = edges.select("src", "dst").distinct().withColumn("_o", seeded_order(F.concat_ws("|", "src", "dst"), seed)).withColumn("_b", F.substring("_o", 1, 3))
    counts = e.groupBy("_b").agg(F.count("*").alias("c"))  # at most 4,096 rows
    before = counts.withColumn("_before", F.sum("c").over(Window.orderBy("_b")) - F.col("c")).withColumn("_n", F.sum("c").over(Window.partitionBy()))
    ranked = e.join(F.broadcast(before), "_b").withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_o", "src", "dst")) + F.col("_before"))
    return ranked.where(F.col("_i") > F.floor(F.col("_n") * fraction)).select("src", "dst")


def without(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """edges (src, dst, ...) without those of lost (src, dst), which must all be among them, each once: else an error, for what is measured then isn't what was asked for."""
    left = cut(edges.join(lost.select("src", "dst"), ["src", "dst"], "left_anti"))
    had, gone, now = edges.count(), lost.count(), left.count()
    if had - gone != now:
        raise ValueError(f"{had} edges less {gone} are {had - gone}, but {now} are left")
    return left


def restored(left: DataFrame, lost: DataFrame, whole: int) -> DataFrame:
    """The edges left and those lost, if together they are as many different ones as before; else an error."""
    back = cut(left.unionByName(lost).dropDuplicates(["src", "dst"]))
    if (now := back.count()) != whole:
        raise ValueError(f"{now} edges are back, not {whole}")
    return back


def crossing(means: DataFrame, falling: str, other: str) -> DataFrame:
    """One row: the first fraction at which `falling` is no better than `other`; null if it always is. means: (fraction, arm, recall)."""
    side = lambda a: means.where(F.col("arm") == a).select("fraction", F.col("recall").alias(a))
    return side(falling).join(side(other), "fraction").where(F.col(falling) <= F.col(other)).agg(F.min("fraction").alias("fraction"))


def haystack(docs: DataFrame, gold: DataFrame, size: int, seed: int) -> DataFrame:
    """docs (id, ...) of one size: all gold, filled up in a hashed order, so a larger haystack holds the smaller ones."""
    needles = docs.join(gold.select("id").distinct(), "id", "left_semi")
    rest = docs.join(gold.select("id").distinct(), "id", "left_anti").withColumn("_o", seeded_order("id", seed))
    return needles.unionByName(rest.orderBy("_o", "id").limit(max(0, size - needles.count())).drop("_o"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, before, after, change): questions whose recall differs between two runs; null on one side counts as a difference."""
    a, b = before.select("question_id", F.col("recall").alias("before")), after.select("question_id", F.col("recall").alias("after"))
    rows = a.join(b, "question_id", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.coalesce("before", F.lit(0.0)) == 0, "rescued").when(F.coalesce("after", F.lit(0.0)) > F.col("before"), "better").otherwise("worse")
    return rows.withColumn("change", change)


def peaks(by_seed: DataFrame, share: float = 0.8) -> DataFrame:
    """One row from (seed, fraction, short): at which fraction partly wrong answers are most, and whether in at least `share` of the seeds they become fewer after.

    Partly wrong answers peak in the middle: with little damage most are whole, with much most are empty.
    """
    w = Window.partitionBy("seed")
    top = by_seed.withColumn("_most", F.max("short").over(w)).withColumn("_end", F.max_by("short", "fraction").over(w))
    each = top.groupBy("seed").agg(F.min(F.when(F.col("short") == F.col("_most"), F.col("fraction"))).alias("peak"), F.first(F.col("_end") < F.col("_most")).alias("falls"))
    return each.agg(F.round(F.avg("peak"), 6).alias("peak"), F.count_if("falls").alias("falling"), F.count("*").alias("seeds"), (F.count_if("falls") >= share * F.count("*")).alias("falls"))
