"""Rank fusion, packing into a token budget, and a control that ignores the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, TOP, BUDGET = 60, 40, 3000


def reciprocal_ranks(rankings: list[DataFrame], top: int = TOP, k: int = K) -> DataFrame:
    """(question_id, id, score, place) from rankings (question_id, id, place).

    In each ranking an id counts once, at its best place. Scores sum 1 / (k + place); equal scores: the
    better place in the earlier ranking, then the id.
    """
    once = [r.groupBy("question_id", "id").agg(F.min("place").alias("place")).withColumn("_of", F.lit(i)) for i, r in enumerate(rankings)]
    rows = once[0]
    for r in once[1:]:
        rows = rows.unionByName(r)
    scored = rows.groupBy("question_id", "id").agg(F.round(F.sum(1 / (k + F.col("place"))), 9).alias("score"), F.min(F.struct("_of", "place")).alias("_first"))
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), "_first", "id")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top).drop("_first")


def packed(pieces: DataFrame, by: str, budget: int = BUDGET, token: str = "tokens", place: str = "place", piece: str = "id") -> DataFrame:
    """(by, pieces, tokens): whole pieces in order of place, each that still fits; one too large is passed over, not an end.

    What is skipped takes nothing, so this is a fold over a group, whose size the ranking's top bounds.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(piece).alias("id"), F.col(token).cast("long").alias("t"))))
    kind = dict(pieces.dtypes)[piece]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    add = lambda a, x: F.when(a["used"] + x["t"] <= budget, F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    return pieces.groupBy(by).agg(order.alias("_o")).select(by, F.aggregate("_o", start, add).alias("_f")).select(by, F.col("_f.ids").alias("pieces"), F.col("_f.used").alias("tokens"))


def seeded_order(key: str | Column, seed: int) -> Column:
    """A shuffle that any engine can repeat: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def control(docs: DataFrame, questions: DataFrame, seed: int = 0, top: int = TOP) -> DataFrame:
    """(question_id, id, place): the same shuffled documents for every question. The first `top` are found once."""
    first = docs.select("id", seeded_order("id", seed).alias("o")).orderBy("o", "id").limit(top)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("o", "id"))).drop("o")
    return questions.select("question_id").join(F.broadcast(placed))  # at most `top` rows
