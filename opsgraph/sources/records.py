"""Records as JSON lines: explicit schemas, reading, writing with a digest, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields by record, as DDL; work notes are positional triples on disk.
SCHEMAS = {
    "configuration_items": "key string, name string, sys_class_name string, environment string, region string, domain string, operational_status int, install_status int, discovery_source string, last_discovered timestamp, sys_id string",
    "relationships": "parent_key string, child_key string, type_name string, last_discovered timestamp",
    "incidents": "number string, short_description string, description string, ci_key string, category string, priority int, opened_at timestamp, resolved_at timestamp, assignment_group string, caller string, close_notes string, work_notes array<array<string>>, duplicate_of string",
    "changes": "number string, short_description string, description string, ci_key string, change_type string, risk string, opened_at timestamp, planned_start timestamp, planned_end timestamp, actual_start timestamp, actual_end timestamp, close_code string, assigned_to string, raised_after_incident string",
    "problems": "number string, short_description string, description string, ci_key string, category string, opened_at timestamp, resolved_at timestamp, workaround string, cause_notes string, incident_numbers array<string>",
    "knowledge": "number string, problem_number string, short_description string, text string, category string, published_at timestamp, views int",
}


def read(spark: SparkSession, folder: str, name: str, mode: str = "FAILFAST") -> DataFrame:
    """A record table; blank lines are skipped, times without an offset taken as UTC. A line that isn't JSON is an error, or with PERMISSIVE a row of nulls (see bad_lines); none is dropped unseen."""
    df = spark.read.schema(SCHEMAS[name]).option("mode", mode).json(f"{folder}/{name}.jsonl")
    if name == "incidents":
        df = df.withColumn("work_notes", F.transform("work_notes", lambda n: F.struct(F.to_timestamp(F.get(n, 0)).alias("at"), F.get(n, 1).alias("author"), F.get(n, 2).alias("text"))))
    return df


def bad_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(line): lines of a record table that aren't JSON of its schema, blank ones apart."""
    lines = spark.read.text(f"{folder}/{name}.jsonl").where(F.trim("value") != "")
    parsed = F.from_json("value", f"{SCHEMAS[name]}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.col("value").alias("line"), parsed.alias("p")).where("p._bad is not null").select("line")


def dictionary(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, place, column, type, nullable): the columns of the tables, without reading a row."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(spark.table(n).schema, 1)]
    return spark.createDataFrame(rows, "table string, place int, column string, type string, nullable boolean")


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and 16 hex digits that don't depend on their order: sums of hashes, so nothing is sorted."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(20,0)"))
    n, a, b = df.agg(F.count("*"), part(1), part(9)).first()
    return n, f"{int(a or 0) % (1 << 32):08x}{int(b or 0) % (1 << 32):08x}"


def write(df: DataFrame, path: str) -> tuple[int, str]:
    """Writes JSON lines, fields in the order of their names; gives count and digest of what was written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return digest(df)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with incoming's rows by key: a known key's row is replaced, others are added. Of several incoming rows the one of greatest `order` wins, among equals and without an order the greatest by its columns."""
    row = F.struct(*incoming.columns)
    one = incoming.groupBy(key).agg((F.max(row) if order is None else F.max(F.struct(F.col(order).alias("_o"), row.alias("_r")))["_r"]).alias("r")).select("r.*")
    return existing.join(one.select(key), key, "left_anti").unionByName(one.select(existing.columns))


def missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't there yet: what a resumed load still has to send."""
    return incoming.join(existing.select(key), key, "left_anti")


def complete(written: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """written, if every wanted key is in it; else an error with how many aren't."""
    short = missing(written, wanted, key).count()
    if short:
        raise ValueError(f"{short} rows were not written")
    return written


def resolved(rows: DataFrame, names: DataFrame, column: str, name: str = "name") -> DataFrame:
    """rows joined with a dimension by name; a name that the dimension lacks is an error, found before anything is joined."""
    lost = [r[0] for r in rows.select(column).distinct().join(names, F.col(column) == names[name], "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"unknown in {column}: {', '.join(map(str, lost))}")
    return rows.join(names.withColumnRenamed(name, column), column)


def closed(edges: DataFrame, items: DataFrame, a: str = "parent_key", b: str = "child_key", key: str = "key") -> DataFrame:
    """Edges whose two ends are known items."""
    known = items.select(F.col(key)).distinct()
    return edges.join(known.withColumnRenamed(key, a), a, "left_semi").join(known.withColumnRenamed(key, b), b, "left_semi").select(edges.columns)


def linked(rels: DataFrame, types: DataFrame, sys_ids: DataFrame) -> DataFrame:
    """Edges as the platform takes them: (parent, child, type), by their ids. An unknown type is an error; an edge with an end that has no id is left out."""
    known = resolved(rels, types.select("name", F.col("sys_id").alias("type")), "type_name")
    side = lambda c: sys_ids.select(F.col("key").alias(f"{c}_key"), F.col("sys_id").alias(c))
    return known.join(side("parent"), "parent_key").join(side("child"), "child_key").select("parent", "child", "type").distinct()


def reconciled(items: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, sys_id, is_new) of each item (key, name, sys_class_name): an existing row (sys_id, key, name, sys_class_name) of its key, else of its name and class, lends its id; new ones have one made of the key.

    Of several existing rows the least id counts; one existing row may stand for several items of a name, as the platform would have it.
    """
    by_key = existing.where("key is not null").groupBy("key").agg(F.min("sys_id").alias("_a"))
    by_name = existing.groupBy("name", "sys_class_name").agg(F.min("sys_id").alias("_b"))
    rows = items.select("key", "name", "sys_class_name").join(by_key, "key", "left").join(by_name, ["name", "sys_class_name"], "left")
    return rows.select("key", F.coalesce("_a", "_b", F.md5("key")).alias("sys_id"), (F.col("_a").isNull() & F.col("_b").isNull()).alias("is_new"))


def platform_graph(cis: DataFrame, rels: DataFrame, incidents: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """The smaller graph that platform rows make: items by their ids, SUPPORTS edges between known items (without dates, which the platform hasn't), and AFFECTS and CHANGES of tickets whose item is known. Fields are dual-valued."""
    items = cis.select(F.col("sys_id").alias("key"), stored("name", "display_value").alias("name"), stored("sys_class_name").alias("sys_class_name")).dropDuplicates(["key"])
    ends = rels.select(stored("child").alias("child_key"), stored("parent").alias("parent_key"), stored("type", "display_value").alias("type_name"))
    known = items.select("key")
    ticket = lambda df: df.select(stored("number", "display_value").alias("number"), stored("cmdb_ci").alias("key")).join(known, "key", "left_semi").dropDuplicates(["number", "key"])
    return {"items": items, "supports": closed(ends, items).distinct(), "affects": ticket(incidents), "changes": ticket(changes)}


def stored(column: str, half: str = "value") -> F.Column:
    """One half of a dual-valued field: `value` is what joins are on, `display_value` what people read. Blank is null."""
    c = F.col(f"{column}.{half}")
    return F.when(F.trim(c) != "", c)


def platform_incident(incidents: DataFrame, sys_ids: DataFrame) -> DataFrame:
    """Incidents in the platform's fields. All four fields of a resolution are set, or none."""
    done = F.col("resolved_at").isNotNull()
    rows = incidents.join(sys_ids.select(F.col("key").alias("ci_key"), "sys_id"), "ci_key", "left")
    return rows.select(
        "number", "short_description", "description", F.coalesce("sys_id", F.lit("")).alias("cmdb_ci"), F.col("priority").alias("impact"), "opened_at",
        F.when(done, F.lit("6")).otherwise(F.lit("2")).alias("state"),
        F.when(done, F.col("resolved_at")).alias("resolved_at"), F.when(done, F.coalesce("close_notes", F.lit("Resolved"))).alias("close_notes"), F.when(done, F.lit("Solved (Permanently)")).alias("close_code"),
    )


def platform_change(changes: DataFrame, sys_ids: DataFrame) -> DataFrame:
    """Changes in the platform's fields; unset actual times stay unset, and risk becomes the platform's number."""
    risk = F.element_at(F.create_map(*(F.lit(x) for pair in (("high", "2"), ("moderate", "3"), ("low", "4")) for x in pair)), F.col("risk"))
    rows = changes.join(sys_ids.select(F.col("key").alias("ci_key"), "sys_id"), "ci_key", "left")
    return rows.select("number", "short_description", "description", F.coalesce("sys_id", F.lit("")).alias("cmdb_ci"), F.col("change_type").alias("type"), risk.alias("risk"), F.col("planned_start").alias("start_date"), F.col("planned_end").alias("end_date"), F.col("actual_start").alias("work_start"), F.col("actual_end").alias("work_end"), "close_code")


def platform_problem(problems: DataFrame, sys_ids: DataFrame) -> DataFrame:
    """Problems in the platform's fields; the related incidents go as a list."""
    rows = problems.join(sys_ids.select(F.col("key").alias("ci_key"), "sys_id"), "ci_key", "left")
    return rows.select("number", "short_description", F.coalesce("sys_id", F.lit("")).alias("cmdb_ci"), "category", "opened_at", F.when(F.col("resolved_at").isNotNull(), "107").otherwise("102").alias("state"), "resolved_at", F.col("workaround").alias("workaround"), F.array_join("incident_numbers", ",").alias("related_incidents"))


def platform_article(articles: DataFrame, base: str) -> DataFrame:
    """Articles in the platform's fields, in a knowledge base."""
    return articles.select("number", F.split_part("text", F.lit("\n"), F.lit(1)).alias("short_description"), "text", F.lit(base).alias("kb_knowledge_base"), F.lit("published").alias("workflow_state"))


def deleted(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids.select(key).distinct(), key, "left_anti")


def kept_rows(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """df from its copy at path; made, or made anew, if there is none or it is asked for."""
    from pyspark.errors import AnalysisException

    if not refresh:
        try:
            return df.sparkSession.read.parquet(path)
        except AnalysisException:
            pass
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def directions(edges: DataFrame, items: DataFrame, cls: str) -> DataFrame:
    """(type_name, as_parent, as_child): at which end of its edges a class of items stands; both ends of one type show a mix-up."""
    own = items.where(F.col("cls") == cls).select("key")
    side = lambda c, name: edges.join(own.withColumnRenamed("key", c), c, "left_semi").groupBy("type_name").agg(F.count("*").alias(name))
    return side("parent", "as_parent").join(side("child", "as_child"), "type_name", "full").fillna(0, ["as_parent", "as_child"])


def settings(path: str) -> dict[str, str]:
    """KEY=value lines of a file on the driver; quotes go, other lines are passed over."""
    import re

    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if m := re.match(r"\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
                found[m[1]] = m[2].strip("\"'")
    return found
