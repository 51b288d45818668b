"""From questions to a scored table: arms that retrieve, what they fit into the budget, and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.text import approx_tokens
from opsgraph.operators import evaluate, fuse, graph, lexical, vector


class Arm(Protocol):
    """All questions at once: questions (question_id, text, ...) -> (question_id, id, place)."""

    name: str

    def retrieve(self, questions: DataFrame) -> DataFrame: ...


@dataclass
class Lexical:
    docs: DataFrame
    stemmed: bool = False
    name: str = "bm25"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        found = lexical.search_stemmed(self.docs, questions) if self.stemmed else lexical.search(lexical.index(self.docs), questions)
        return found.select("question_id", "id", "place")


@dataclass
class Vectors:
    vectors: DataFrame
    embed: Callable[[DataFrame], DataFrame]
    name: str = "vector"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return vector.nearest(self.vectors, self.embed(questions)).select("question_id", "id", "place")


@dataclass
class Control:
    docs: DataFrame
    name: str = "control"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return fuse.control(self.docs, questions)


@dataclass
class Fused:
    arms: list[Arm]
    name: str = "hybrid"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return fuse.reciprocal_ranks([a.retrieve(questions) for a in self.arms]).select("question_id", "id", "place")


def sentences(items: DataFrame, reached_from: str | None = None) -> F.Column:
    """What is said of a reached item of items (key, name, cls, environment)."""
    said = [F.col("key"), F.lit(" "), F.col("name"), F.lit(" is a "), F.col("cls"), F.lit(" in the "), F.col("environment"), F.lit(" environment")]
    return F.concat(*said, *([F.lit(", reached from "), F.col(reached_from)] if reached_from else []), F.lit("."))


@dataclass
class Named:
    """The graph alone: from the items that a question names, both ways over edges (src, dst), the items themselves left out.

    Each named item walks once, however many questions name it; the nearest `limit` of each are taken,
    those of the longest name first. What is reached comes with its sentence.
    """

    edges: DataFrame
    items: DataFrame
    names: DataFrame | None = None
    limit: int = 60
    hops: int = 4
    name: str = "graph_only"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        entries = graph.entry_points(questions, (self.names if self.names is not None else self.items).select("key", "name")).select("question_id", F.col("key").alias("start"), F.col("place").alias("_entry"))
        reached = graph.walk(self.edges, entries.select("start").distinct(), self.hops, self.limit + 1).where("hop > 0").where(F.col("place") <= self.limit + 1)
        once = entries.join(reached, "start").groupBy("question_id", "node").agg(F.min(F.struct("_entry", "place", "start")).alias("_m"))
        by = Window.partitionBy("question_id").orderBy("_m._entry", "_m.place")
        placed = once.select("question_id", F.col("node").alias("id"), F.col("_m.start").alias("_from"), F.row_number().over(by).alias("place"))
        return placed.join(self.items.withColumn("id", F.col("key")), "id").select("question_id", "id", "place", sentences(self.items, "_from").alias("text"))


@dataclass
class Walked:
    """A walk from the items that another arm's first records stand for: items are themselves, incidents and changes their item, others none."""

    seeds: Arm
    edges: DataFrame
    items: DataFrame
    incidents: DataFrame
    changes: DataFrame
    first: int = 8
    limit: int = 80
    top: int = 40
    name: str = "vector_walk"

    def retrieve(self, questions: DataFrame) -> DataFrame:
        ranked = self.seeds.retrieve(questions).where(F.col("place") <= self.first).select("question_id", F.col("id").cast("string").alias("record_id"))
        found = walked(ranked, self.edges, self.items, self.incidents, self.changes, self.limit, self.top)
        return found.join(self.items.withColumn("id", F.col("key")), "id").select("question_id", "id", "place", sentences(self.items).alias("text"))


def walked(ranked: DataFrame, edges: DataFrame, items: DataFrame, incidents: DataFrame, changes: DataFrame, limit: int = 80, top: int = 40) -> DataFrame:
    """(question_id, id, hop, place): around the items that the records of ranked (question_id, record_id) stand for, these included, the nearest `limit` of all and of them the first `top`."""
    stand = graph.seeds(ranked.select("record_id").distinct(), items, incidents, changes).withColumnRenamed("start", "record_id")
    begin = ranked.join(stand, "record_id").select(F.col("question_id").alias("start"), "node").distinct()
    found = graph.walk(edges, begin, limit=limit).where(F.col("place") <= top)
    return found.select(F.col("start").alias("question_id"), F.col("node").alias("id"), "hop", "place")


def contexts(ranking: DataFrame, docs: DataFrame, budget: int = fuse.BUDGET) -> DataFrame:
    """(question_id, id, place, tokens): what of a ranking fits into the budget, placed anew; tokens are the whole context's. Texts are those of docs, unless the ranking has its own."""
    texts = ranking if "text" in ranking.columns else ranking.join(docs.select("id", "text"), "id")
    sized = texts.select("question_id", "id", "place", approx_tokens("text").alias("tokens"))
    packed = fuse.packed(sized, "question_id", budget)
    return packed.select("question_id", "tokens", F.posexplode("pieces").alias("place", "id")).withColumn("place", F.col("place") + 1)


def run(arms: list[Arm], questions: DataFrame, gold: DataFrame, docs: DataFrame, budget: int = fuse.BUDGET) -> DataFrame:
    """evaluate.scored for every arm. questions: question_id, text, kind, holdout, gradable, expect_empty. An arm whose plan can't be made fails all its questions, and the others go on."""
    asked, retrieved = None, None
    for arm in arms:
        error, got = None, None
        try:
            got = contexts(arm.retrieve(questions), docs, budget)
        except Exception as wrong:  # noqa: BLE001  any arm may be given
            error = str(wrong)[:200]
        own = questions.withColumn("arm", F.lit(arm.name)).withColumn("error", F.lit(error).cast("string"))
        own = own.join(got.groupBy("question_id").agg(F.max("tokens").alias("tokens")), "question_id", "left").fillna(0, ["tokens"]) if got is not None else own.withColumn("tokens", F.lit(0).cast("long"))
        asked = own if asked is None else asked.unionByName(own)
        if got is not None:
            rows = got.select(F.lit(arm.name).alias("arm"), "question_id", "id", "place")
            retrieved = rows if retrieved is None else retrieved.unionByName(rows)
    if retrieved is None:
        retrieved = gold.select(F.lit("").alias("arm"), "question_id", "id", F.lit(0).alias("place")).limit(0)
    return evaluate.scored(asked, retrieved, gold, docs.count())


def reachable(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, floor): the share of each question's gold (question_id, id) that is in the corpus at all; no arm's recall can be above it."""
    marked = gold.select("question_id", "id").distinct().join(docs.select("id", F.lit(1).alias("_in")).distinct(), "id", "left")
    return marked.groupBy("question_id").agg((F.count("_in") / F.count("*")).alias("floor"))


def report(scores: DataFrame, gold: DataFrame | None = None, docs: DataFrame | None = None) -> str:
    """A table of the arms; recall of held-out and other questions, by kind, and of enumerations against chance; which differences are real; and, with gold and docs, what of the gold could be found."""
    show = lambda x: "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    row = lambda values: "  ".join(f"{show(v):>12}" for v in values)
    arms_ = evaluate.by_arm(scores).orderBy(F.desc_nulls_last("recall"), "arm").collect()
    lines = []

    def section(title: str, columns: tuple[str, ...], rows: list) -> None:
        lines.extend(["", title, row(columns), *(row(r[c] for c in columns) for r in rows)] if rows else [])

    section("arms", ("arm", "asked", "failed", "measured", "recall", "mrr", "precision", "tokens_mean", "tokens_when_answered"), arms_)
    section("held out", ("arm", "recall_held_out", "recall_seen"), arms_)
    beats = [r.asDict() | {"beats_chance": r.precision_enumerations is not None and r.chance is not None and r.precision_enumerations > 1.5 * r.chance} for r in arms_ if r.enumerations]
    section("enumerations", ("arm", "enumerations", "precision_enumerations", "chance", "beats_chance"), beats)
    section("by kind", ("kind", "arm", "measured", "recall", "mrr"), evaluate.by_kind(scores).where("measured > 0").orderBy("kind", F.desc("recall"), "arm").collect())
    if gold is not None and docs is not None:
        section("reachable", ("questions", "floor"), reachable(gold, docs).agg(F.count("*").alias("questions"), F.avg("floor").alias("floor")).collect())
    lines += ["", *(f"{r.arm} against {r.other}: {r.wins} won, {r.losses} lost, p {r.p:.3f}, {'real' if r.real else 'no real difference'}" for r in evaluate.compared(scores).orderBy("arm", "other").collect())]
    return "\n".join(lines).strip()


def kept(scores: DataFrame, path: str) -> None:
    """Scores, and a row an arm, as JSON lines below a folder."""
    scores.write.mode("overwrite").json(f"{path}/scores")
    evaluate.by_arm(scores).coalesce(1).write.mode("overwrite").json(f"{path}/arms")
