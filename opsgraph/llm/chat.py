"""Preference formatting of conversations, in DataFrame functions.

A chosen and a rejected conversation share their first turns. The longest common prefix of turns is
rendered once, as the prompt; what follows in each is its completion, split into segments of which
only the assistant's own words count for a loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import joined, packed, running, saved, unpacked

TURNS = "array<struct<role:string,text:string>>"
#: The tags that open and close a turn.
OPEN, NAMED, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, turns): the turns of each conversation in order, as an array of (role, text).

    A null role or text is empty; turns of equal order are sorted by role and text; null orders come first;
    repeated turns stay; turns with a null key are in no conversation. A conversation is one row by
    nature, and that bounds what is gathered.
    """
    each = F.struct(F.col(order).alias("o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("turns"))
    return rows.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _spoken(turns: str | Column) -> Column:
    """Code points of the assistant's turns."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + F.when(t["role"] == ASSISTANT, F.length(t["text"])).otherwise(0))


def _branch(turns: Column, said: Column) -> Column:
    """The turns up to one of the assistant's, which repeats the one before it, as a stale answer, or is empty if there is none. Which one the length of all texts decides."""
    at = F.pmod(F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"])), F.size(said)).cast("int")
    stale = F.when(at > 0, F.element_at(turns, F.get(said, at - 1))["text"]).otherwise(F.lit(""))
    return F.concat(F.slice(turns, F.lit(1), F.get(said, at) - 1), F.array(F.struct(F.lit(ASSISTANT).alias("role"), stale.alias("text")))).cast(TURNS)


def pairs(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, other, chosen, rejected) of each conversation with an assistant's turn; both sides run to the last such turn.

    A conversation is paired with one that shares its first turns, as many as any other conversation
    that isn't equal does: of all those with these first turns the one of least key, or, if that is equal,
    the one whose equals' least key is the greatest. chosen is the one in which the assistant says more
    (then: of lesser key). A conversation that shares no turn with another has a null `other`, and is
    rejected with a stale answer at one of the assistant's turns. Keys are integers and unique, as
    conversations() gives them; talks may be empty.

    First turns meet by 128-bit hashes, in aggregations that keep two keys each; the turns of what a
    great many conversations are paired with go out by broadcast.
    """
    said = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("turns"))), lambda i: F.get("turns", i - 1)["role"] == ASSISTANT)
    own = talks.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("turns").cast(TURNS).alias("turns"), said.alias("said")).where(F.size("said") > 0)
    own = saved(own.select("k", F.slice("turns", F.lit(1), F.element_at("said", -1)).alias("turns"), "said"), "talks")

    marks = F.transform("turns", lambda t, i: F.struct(F.xxhash64(i, t["role"], t["text"]).alias("x"), F.xxhash64(t["text"], i, t["role"]).alias("y")))
    nothing = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    firsts = running(marks, nothing, lambda a, b: F.struct(a["x"].bitwiseXOR(b["x"]).alias("x"), a["y"].bitwiseXOR(b["y"]).alias("y")))
    marked = own.select("k", firsts.alias("f")).select("k", F.element_at("f", -1).alias("h"), F.posexplode("f").alias("d", "p"))
    rows = saved(marked.select("k", "h", F.struct("d", "p").alias("p")), "firsts")
    kinds = rows.groupBy("p", "h").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    shared = kinds.groupBy("p").agg(F.min(F.struct("k", "h")).alias("a"), F.max("k").alias("b"), F.sum("n").alias("n")).where("a.k <> b")
    shared = saved(shared, "shared")
    deepest = joined(rows, shared.drop("n"), "p", shared, rows.count()).groupBy("k").agg(F.max(F.struct("p.d", "h", "a", "b")).alias("m"))
    asked = saved(deepest.select("k", F.when(F.col("m.h") == F.col("m.a.h"), F.col("m.b")).otherwise(F.col("m.a.k")).alias("other")), "asked")
    met = joined(asked, own.select(F.col("k").alias("other"), F.col("turns").alias("theirs")), "other", asked.groupBy("other").agg(F.count("*").alias("n")), asked.count())

    two = own.join(met, "k", "left")
    mine, theirs = _spoken("turns"), _spoken("theirs")
    first = (mine > theirs) | ((mine == theirs) & (F.col("k") < F.col("other")))
    side = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    alone = F.col("other").isNull()
    return two.select(
        F.col("k").alias(key), "other", F.when(alone, F.col("turns")).otherwise(side("turns", "theirs")).alias("chosen"), F.when(alone, _branch(F.col("turns"), F.col("said"))).otherwise(side("theirs", "turns")).alias("rejected")
    )


def common_turns(a: str | Column, b: str | Column) -> Column:
    """How many first turns are equal, role and text (null equals null)."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & F.isnotnull(x))
    return F.coalesce(F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"]), F.lit(0))


def rendered(turns: str | Column) -> Column:
    """Turns as text, each between its tags."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(NAMED), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))), "")


def masked(turns: str | Column) -> Column:
    """Turns as segments (text, loss): tags and others' words have loss 0, an assistant's words and its closing tag 1."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(NAMED)).alias("text"), F.lit(0).alias("loss")),
                F.struct(F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)).alias("text"), F.when(t["role"] == ASSISTANT, 1).otherwise(0).alias("loss")),
            ),
        )
    )


def preferences(talks: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """talks with common_turns, prompt, and chosen_segments and rejected_segments: arrays of (text, loss).

    The prompt and the texts of a side's segments joined are that conversation rendered. Null
    conversations are empty ones; of equal conversations all is prompt, and the segments are empty.
    Repeated rows stay. Other columns stay; columns of these names are replaced.
    """
    side = lambda c: F.coalesce(F.transform(F.col(c).cast(TURNS), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), F.array().cast(TURNS))
    own = packed(talks, _a=side(chosen), _b=side(rejected))
    work = own.withColumn("_n", common_turns("_a", "_b"))
    rest = lambda c: masked(F.slice(c, F.col("_n") + 1, F.size(c)))
    return unpacked(work, talks, common_turns="_n", prompt=rendered(F.slice("_a", F.lit(1), F.col("_n"))), chosen_segments=rest("_a"), rejected_segments=rest("_b"))
