"""Questions to tickets and items that a query answers: joins, anti-joins, time joins and greatest-of-group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.times import out_of_hours
from opsgraph.operators.graph import named_in, reach
from opsgraph.operators.paths import path_counts
from opsgraph.plans.lineage import cut


def latest(rows: DataFrame, by: str, at: str, number: str = "number", n: int = 1) -> DataFrame:
    """The n latest rows of each `by`; equal times: the greater number."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(number))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def most_frequent(rows: DataFrame, by: str, n: int = 1) -> DataFrame:
    """(by, n): the groups with most rows; ties: the least key."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def without(items: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Items whose key is in no row's column."""
    return items.join(rows.select(F.col(column).alias("key")), "key", "left_anti")


def overran(changes: DataFrame, factor: float = 1.3) -> DataFrame:
    """Changes whose work took over `factor` times the planned time; those without an actual end didn't."""
    seconds = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b))
    return changes.where(F.col("actual_start").isNotNull() & F.col("actual_end").isNotNull() & (seconds("actual_start", "actual_end") > factor * seconds("planned_start", "planned_end")))


def _cell(at: str | Column, hours: int) -> Column:
    """The stretch of so many hours that a time lies in."""
    return F.floor(F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp")) / (hours * 3_600_000_000))


def followed(changes: DataFrame, incidents: DataFrame, days: int = 2) -> DataFrame:
    """Changes with an incident on the same item after their actual end and within the days: an interval semi-join.

    The join's key is item and stretch of time, each change standing in two stretches, so a busy item spreads out.
    """
    hours = 24 * days
    i = incidents.select(F.col("ci_key").alias("_ci"), F.col("opened_at").alias("_at"), _cell("opened_at", hours).alias("_cell")).where("_ci is not null")
    c = changes.where("actual_end is not null").select("number", "ci_key", "actual_end", F.explode(F.array(_cell("actual_end", hours), _cell("actual_end", hours) + 1)).alias("cell"))
    on = (F.col("ci_key") == F.col("_ci")) & (F.col("cell") == F.col("_cell")) & (F.col("_at") > F.col("actual_end")) & (F.col("_at") < F.col("actual_end") + F.expr(f"interval '{days}' day"))
    return changes.join(c.join(i, on, "left_semi").select("number").distinct(), "number", "left_semi")


def preceding_changes(incidents: DataFrame, changes: DataFrame, hours: int = 24, reactive: bool = False, edges: DataFrame | None = None, near: int = 2, paths: bool = False) -> DataFrame:
    """(incident, change, minutes): changes that ended within the hours before an incident opened, on its item or, with edges (src, dst), on one that supports it in at most `near` steps.

    Changes raised after an incident follow it rather than cause it and are left out, unless asked for.
    A change that is near in several ways is one row; with paths (edges being rows, near 2 at most), that
    says by how many different ones. Both sides are cut into stretches of the window's
    length, each change standing in its own and the next, so that the join's key is item and stretch, and
    an item with very many records spreads out.
    """
    own = changes.where("actual_end is not null" + ("" if reactive else " and raised_after_incident is null"))
    c = own.select("ci_key", F.col("number").alias("change"), "actual_end", F.explode(F.array(_cell("actual_end", hours), _cell("actual_end", hours) + 1)).alias("cell"))
    i = incidents.where("ci_key is not null").select("ci_key", F.col("number").alias("incident"), "opened_at", _cell("opened_at", hours).alias("cell"))
    if edges is not None:
        # Incidents' items walk to what supports them: an item needs few others, but a hub supports very many. Only changed items stay, and a change
        # isn't copied to all that its item supports: an incident stands once for each changed item near it.
        hit = i.select(F.col("ci_key").alias("start")).distinct()
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        support = path_counts(back, hit, near) if paths else reach(back, hit, near, include_start=True).drop("hop")
        support = cut(support.join(own.select(F.col("ci_key").alias("node")).distinct(), "node", "left_semi"))
        i = i.join(support.withColumnRenamed("start", "ci_key"), "ci_key").drop("ci_key").withColumnRenamed("node", "ci_key")
    found = i.join(c, ["ci_key", "cell"]).where((F.col("actual_end") < F.col("opened_at")) & (F.col("actual_end") > F.col("opened_at") - F.expr(f"interval '{hours}' hour")))
    return found.select("incident", "change", F.floor(F.timestamp_diff("SECOND", F.col("actual_end"), F.col("opened_at")) / 60).alias("minutes"), *(["paths"] if paths and edges is not None else []))


def seen_before(incidents: DataFrame, problems: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(number, earlier, problem, workaround): a repeat, what it repeats, and the problem that groups that; no problem: not listed.

    With articles also article: one row for each that documents the problem, null if none does.
    """
    grouped = problems.select(F.col("number").alias("problem"), "workaround", F.explode("incident_numbers").alias("earlier"))
    found = incidents.where("duplicate_of is not null").select("number", F.col("duplicate_of").alias("earlier")).join(grouped, "earlier")
    return found if articles is None else found.join(articles.select(F.col("problem_number").alias("problem"), F.col("number").alias("article")), "problem", "left")


def misrouted(incidents: DataFrame, items: DataFrame) -> DataFrame:
    """Incidents whose item's domain isn't in their group's name, letter case aside: (number, assignment_group). Unlinked ones aren't judged."""
    owned = incidents.join(items.select(F.col("key").alias("ci_key"), "domain"), "ci_key")
    return owned.where(~F.contains(F.lower("assignment_group"), F.lower("domain"))).select("number", "assignment_group")


def names_another(tickets: DataFrame, prefix: str = "INC") -> DataFrame:
    """Tickets whose description names a ticket besides themselves."""
    return tickets.where(F.contains(F.replace("description", F.col("number"), F.lit("")), F.lit(prefix)))


def stale_share(edges: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """One row: share, the part of dated edges not confirmed within the days before as_of; null without any."""
    old = F.datediff(as_of, F.col("last_discovered")) > days
    return edges.where("last_discovered is not null").agg(F.round(F.avg(old.cast("double")), 6).alias("share"), F.count("*").alias("n"))


def outside_hours(rows: DataFrame, at: str, from_: Column, to: Column) -> DataFrame:
    """Rows out of hours in [from_, to)."""
    return rows.where((F.col(at) >= from_) & (F.col(at) < to) & out_of_hours(at))


def rates(incidents: DataFrame, edges: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """One row of measured rates, to four places; with edges and items also how many linked incidents' notes name a neighbour."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    found = incidents.agg(
        F.count("*").alias("incidents"),
        share(F.col("ci_key").isNull()).alias("unlinked"),
        share(F.col("resolved_at").isNull()).alias("open"),
        share(F.col("duplicate_of").isNotNull()).alias("repeats"),
        share(F.contains(F.replace("description", F.col("number"), F.lit("")), F.lit("INC"))).alias("cross_referenced"),
        share(F.col("priority") == 1).alias("p1"),
        share(F.hour("opened_at").between(8, 17)).alias("by_day"),
        F.countDistinct("caller").alias("callers"),
        F.count("ci_key").alias("_linked"),
    )
    if edges is None or items is None:
        return found.drop("_linked")
    named = notes_naming_neighbour(incidents, edges, items).agg(F.count("*").alias("_named"))
    return found.join(named).withColumn("names_neighbour", F.round(F.col("_named") / F.nullif("_linked", F.lit(0)), 4)).drop("_linked", "_named")  # two single rows


def notes_naming_neighbour(incidents: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """Incidents whose notes name an item next to their own: (number).

    What the notes name is found first, by name; being neighbours is then an equality join, so an
    item with very many neighbours costs no row an incident.
    """
    own = incidents.where("ci_key is not null").select("number", "ci_key", F.array_join(F.transform("work_notes", lambda n: n["text"]), " ").alias("text"))
    named = named_in(own.select(F.col("number").alias("question_id"), "text"), items.select("key", "name"), folded=False)
    found = cut(own.select("number", "ci_key").join(named.select(F.col("question_id").alias("number"), "key"), "number"))
    either = lambda df, a, b, c, d: df.select(F.col(a).alias(c), F.col(b).alias(d)).union(df.select(F.col(b).alias(c), F.col(a).alias(d)))
    ends = either(found, "ci_key", "key", "parent", "child").distinct()
    near = edges.select("parent", "child").join(ends.hint("shuffle_hash"), ["parent", "child"], "left_semi")  # edges pass by what was named, they are neither sorted nor gathered
    return found.join(either(near, "parent", "child", "ci_key", "key"), ["ci_key", "key"], "left_semi").select("number").distinct()


def state_word(code: Column) -> Column:
    """The platform's state numbers as words."""
    return F.when(code == 1, "New").when(code == 2, "In Progress").when(code == 6, "Resolved").when(code == 7, "Closed").otherwise("Unknown")
