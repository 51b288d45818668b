"""Cutting records into texts for retrieval: (chunk_id, text, strategy, source_kind, source_id, ci_key, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.text import approx_tokens, blank_to_null, capitalised, paragraphs

LEAST_FIELD, LEAST_SECTION = 12, 20


def _chunks(rows: DataFrame, chunk_id: Column, text: Column, strategy: str, kind: str, source: str = "number", ci: Column | None = None) -> DataFrame:
    own = rows.select(chunk_id.alias("chunk_id"), text.alias("text"), F.lit(strategy).alias("strategy"), F.lit(kind).alias("source_kind"), F.col(source).alias("source_id"), (ci if ci is not None else F.lit(None).cast("string")).alias("ci_key"))
    return own.withColumn("tokens", approx_tokens("text"))


def incident_text() -> Column:
    """Facts, title, body, notes and resolution, a blank line between; what is empty is left out."""
    facts = F.concat(
        F.lit("State: "), F.when(F.col("resolved_at").isNotNull(), "Resolved").otherwise("Open"),
        F.lit(". Assigned to "), F.col("assignment_group"), F.lit(". Category: "), F.col("category"), F.lit(". Priority: P"), F.col("priority").cast("string"), F.lit("."),
    )
    notes = F.array_join(F.filter(F.transform("work_notes", lambda n: n["text"]), lambda t: t != ""), "\n\n")
    return paragraphs(facts, F.col("short_description"), F.col("description"), notes, F.when(F.col("close_notes").isNotNull(), F.concat(F.lit("Resolution: "), F.col("close_notes"))))


def per_record(incidents: DataFrame) -> DataFrame:
    return _chunks(incidents, F.concat(F.col("number"), F.lit(":record")), F.concat(F.col("number"), F.lit("\n"), incident_text()), "per_record", "incident", ci=F.col("ci_key"))


def per_field(incidents: DataFrame) -> DataFrame:
    """A chunk for each symptom, body, note and resolution of at least LEAST_FIELD characters."""
    one = lambda name, text: F.struct(F.lit(name).alias("field"), text.alias("text"))
    notes = F.transform("work_notes", lambda n, i: F.struct(F.concat(F.lit("note_"), i.cast("string")).alias("field"), n["text"].alias("text")))
    fields = F.concat(F.array(one("symptom", F.col("short_description")), one("body", F.col("description"))), notes, F.array(one("resolution", F.col("close_notes"))))
    each = incidents.select("number", "ci_key", F.explode(fields).alias("f")).where(F.length(F.trim("f.text")) >= LEAST_FIELD)
    return _chunks(each, F.concat_ws(":", "number", "f.field"), F.concat(F.col("number"), F.lit(" "), F.col("f.text")), "per_field", "incident", ci=F.col("ci_key"))


def neighbours(edges: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(ci_key, needs, dependants): names of up to `most` items each way over impact edges, the least keys first.

    The least keys are found by rank before anything is gathered, so an item with very many neighbours gathers few.
    """
    named = items.select(F.col("key").alias("other"), F.col("name").alias("other_name"))

    def side(own: str, other: str, out: str) -> DataFrame:
        rows = edges.where("impact").select(F.col(own).alias("ci_key"), F.col(other).alias("other")).distinct()
        few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("ci_key").orderBy("other"))).where(F.col("_n") <= most)
        pairs = few.join(named, "other").groupBy("ci_key").agg(F.array_sort(F.collect_list(F.struct("other", "other_name"))).alias("_p"))
        return pairs.select("ci_key", F.transform("_p", lambda x: x["other_name"]).alias(out))

    return side("parent", "child", "needs").join(side("child", "parent", "dependants"), "ci_key", "full")


def denormalised(incidents: DataFrame, items: DataFrame, edges: DataFrame, changes: DataFrame, most: int = 6, recent: int = 3) -> DataFrame:
    """per_record, and what the graph says of the item: its domain, what it needs, what depends on it, its latest changes."""
    own = items.select(F.col("key").alias("ci_key"), "name", "domain")
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("ci_key").orderBy(F.desc("planned_start"), F.desc("number")))).where(F.col("_n") <= recent)
    told = last.groupBy("ci_key").agg(F.array_sort(F.collect_list(F.struct("_n", "number"))).alias("_c")).select("ci_key", F.array_join(F.transform("_c", lambda x: x["number"]), ", ").alias("_changes"))
    rows = incidents.join(own, "ci_key", "left").join(neighbours(edges, items, most), "ci_key", "left").join(told, "ci_key", "left")
    says = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, ", "), F.lit(".")))
    text = paragraphs(
        F.concat(F.col("number"), F.lit("\n"), incident_text()),
        F.concat(F.col("name"), F.lit(" belongs to "), F.col("domain"), F.lit(".")),
        says("It needs ", "needs"),
        says("What depends on it: ", "dependants"),
        F.concat(F.lit("Recent changes: "), F.col("_changes"), F.lit(".")),
    )
    return _chunks(rows, F.concat(F.col("number"), F.lit(":graph")), text, "graph_denormalised", "incident", ci=F.col("ci_key"))


def sections(articles: DataFrame) -> DataFrame:
    """Articles cut before each "## " line; parts under LEAST_SECTION characters go, the numbers of the others stay."""
    each = articles.select("number", F.posexplode(F.split("text", "\n(?=## )")).alias("i", "part")).where(F.length(F.trim("part")) >= LEAST_SECTION)
    return _chunks(each, F.concat(F.col("number"), F.lit(":s"), F.col("i").cast("string")), F.col("part"), "sections", "knowledge")


def problem_chunks(problems: DataFrame) -> DataFrame:
    text = paragraphs(F.concat(F.col("number"), F.lit(" "), F.col("short_description")), F.concat(F.lit("Workaround: "), F.col("workaround")), F.concat(F.lit("Incidents: "), F.array_join("incident_numbers", ", ")))
    return _chunks(problems, F.concat(F.col("number"), F.lit(":problem")), text, "problem", "problem", ci=F.col("ci_key"))


def change_chunks(changes: DataFrame, items: DataFrame) -> DataFrame:
    """Changes with their item's name (else its key) and the actual end (else the planned)."""
    rows = changes.join(items.select(F.col("key").alias("ci_key"), "name"), "ci_key", "left")
    on = F.coalesce(blank_to_null("name"), F.col("ci_key"))
    text = F.concat(F.col("number"), F.lit(": "), F.col("short_description"), F.lit(" on "), on, F.lit(", "), F.col("close_code"), F.lit(", ended "), F.date_format(F.coalesce("actual_end", "planned_end"), "yyyy-MM-dd HH:mm"), F.lit(". "), F.col("description"))
    return _chunks(rows, F.concat(F.col("number"), F.lit(":change")), text, "change", "change", ci=F.col("ci_key"))


def item_chunks(items: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    rows = items.join(neighbours(edges, items, most).withColumnRenamed("ci_key", "key"), "key", "left")
    names = lambda c: F.array_join(c, ", ")
    text = paragraphs(
        F.concat(F.col("name"), F.lit(" is a "), F.col("environment"), F.lit(" "), F.col("cls"), F.lit(" of "), capitalised("domain"), F.lit(".")),
        F.when(F.size("needs") > 0, F.concat(F.lit("It needs "), names("needs"), F.lit("."))),
        F.when(F.size("dependants") > 0, F.concat(names("dependants"), F.when(F.size("dependants") > 1, F.lit(" stop")).otherwise(F.lit(" stops")), F.lit(" when it fails."))),
    )
    return _chunks(rows, F.concat(F.col("key"), F.lit(":item")), text, "item", "item", source="key", ci=F.col("key"))


def size_report(chunks: DataFrame, by: str = "strategy") -> DataFrame:
    """(by, n, total, mean, median, largest); the median of an even number is the upper one. Sizes are counted, not gathered."""
    sizes = chunks.groupBy(by, "tokens").agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(by).orderBy("tokens"))
    all_ = F.sum("c").over(Window.partitionBy(by))
    rows = sizes.withColumns({"_upto": up_to, "_n": all_})
    return rows.groupBy(by).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("tokens").cast("long") * F.col("c")).alias("total"),
        F.round(F.sum(F.col("tokens") * F.col("c")) / F.sum("c"), 6).alias("mean"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col("tokens"))).alias("median"),
        F.max("tokens").alias("largest"),
    )
