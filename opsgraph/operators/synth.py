"""A synthetic estate and its tickets. Every value is a hash of seed, row and slot: any task makes any row, always the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2026-09-01 00:00:00"
DOMAINS = ("checkout", "payments", "search", "identity", "catalogue", "shipping", "reporting", "messaging")
FAMILIES = ("capacity", "latency", "replication", "certificate", "access", "failover", "backup", "deployment")
CLUSTERS, ARRAYS = 6, 3
STALE, UNLINKED, REPEATS, PASTED = 0.18, 0.17, 0.14, 0.3
#: Shares of incidents with an item and family that one of the last PAIRS had, and that name one of the last POOL of their family.
CHRONIC, RELATED, PAIRS, POOL = 0.2, 0.2, 4000, 400


def uniform(seed: int, slot: str, *keys: str) -> Column:
    """In [0, 1), by row and slot."""
    return (F.xxhash64(F.lit(seed), F.lit(slot), *keys).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)


def chosen(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(pairs: tuple[tuple[object, float], ...], u: Column) -> Column:
    out, upto = None, 0.0
    for value, w in pairs[:-1]:
        upto += w
        out = F.when(u < upto, F.lit(value)) if out is None else out.when(u < upto, F.lit(value))
    return out.otherwise(F.lit(pairs[-1][0]))


def items(spark: SparkSession, services: int, seed: int) -> DataFrame:
    """key, name, cls, environment, domain: services, two servers each, clusters and storage arrays, and some that nothing touches."""
    row = lambda n, prefix, cls: spark.range(n).select("id", F.lit(prefix).alias("prefix"), F.lit(cls).alias("cls"))
    all_ = row(services, "svc", "cmdb_ci_service").union(row(2 * services, "srv", "cmdb_ci_linux_server")).union(row(CLUSTERS, "clu", "cmdb_ci_cluster")).union(row(ARRAYS, "san", "cmdb_ci_storage_server")).union(row(max(1, services // 50), "orp", "cmdb_ci_linux_server"))
    key = F.concat_ws("-", "prefix", F.lpad(F.col("id").cast("string"), 6, "0"))
    env = weighted((("prd", 0.5), ("tst", 0.3), ("dev", 0.2)), uniform(seed, "env", "prefix", "id"))
    domain = chosen(DOMAINS, uniform(seed, "domain", "prefix", "id"))
    return all_.select(key.alias("key"), F.concat_ws(" ", domain, F.col("prefix"), F.col("id").cast("string")).alias("name"), "cls", env.alias("environment"), domain.alias("domain"))


def edges(spark: SparkSession, services: int, seed: int) -> DataFrame:
    """parent, child, type_name, last_discovered, impact. Servers run on clusters, clusters on arrays; services depend on others, cycles included; a ring of four carries no impact."""
    key = lambda p, c: F.concat(F.lit(f"{p}-"), F.lpad(c.cast("string"), 6, "0"))
    pick = lambda slot, n: F.floor(uniform(seed, slot, "id") * n).cast("long")
    row = lambda p, c, t: (p.alias("parent"), c.alias("child"), F.lit(t).alias("type_name"))
    svc, srv = spark.range(services), spark.range(2 * services)
    parts = [
        srv.select(*row(key("svc", F.col("id") % services), key("srv", F.col("id")), "Runs on::Runs")),
        srv.select(*row(key("srv", F.col("id")), key("clu", pick("cluster", CLUSTERS)), "Hosted on::Hosts")),
        spark.range(CLUSTERS).select(*row(key("clu", F.col("id")), key("san", F.col("id") % ARRAYS), "Depends on::Used by")),
        svc.withColumn("other", pick("other", services)).where((uniform(seed, "depends", "id") < 0.6) & (F.col("other") != F.col("id"))).select(*row(key("svc", F.col("id")), key("svc", F.col("other")), "Depends on::Used by")),
        spark.range(4).select(*row(key("svc", F.col("id")), key("svc", (F.col("id") + 1) % 4), "IP Connection::IP Connection")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    age = F.when(uniform(seed, "stale", "parent", "child") < STALE, 400 + F.floor(uniform(seed, "age", "parent", "child") * 600)).otherwise(F.floor(uniform(seed, "age", "parent", "child") * 200))
    dated = out.distinct().withColumn("last_discovered", F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(age.cast("int")))
    return dated.withColumn("impact", ~F.startswith("type_name", F.lit("IP")))


def incidents(spark: SparkSession, services: int, n: int, seed: int) -> DataFrame:
    """Incidents by weekday and working hours mostly, with long-tailed repair times.

    A share has the item and family of an earlier one, as faults recur: what those are is a function of that
    one's id alone, so nothing is looked up. Repeats point to the one before on the item and family, related
    ones name one of the last POOL of their family.
    """
    u = lambda slot: uniform(seed, slot, "id")
    like = F.when((u("chronic") < CHRONIC) & (F.col("id") > 0), F.col("id") - 1 - F.floor(u("pair") * F.least(F.col("id"), F.lit(PAIRS))).cast("long")).otherwise(F.col("id"))
    family = chosen(FAMILIES, uniform(seed, "family", "like"))
    item = F.concat(F.lit("svc-"), F.lpad(F.floor(F.pow(uniform(seed, "item", "like"), F.lit(2.0)) * services).cast("long").cast("string"), 6, "0"))
    hour = F.when(u("day") < 0.75, 8 + F.floor((u("h1") + u("h2")) * 5)).otherwise(F.floor(u("h1") * 24))
    opened = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((1 + F.floor(u("date") * 700)).cast("int")) + F.make_dt_interval(F.lit(0), hour.cast("int"), F.floor(u("minute") * 60).cast("int"))
    normal = F.sqrt(-2 * F.log(F.greatest(u("n1"), F.lit(1e-12)))) * F.cos(2 * math.pi * u("n2"))
    minutes = F.least(F.exp(5 + 1.1 * normal), F.lit(60_000.0))
    rows = spark.range(n).withColumn("like", like).select(
        "id", F.concat(F.lit("INC"), F.lpad((F.col("id") + 1_000_000).cast("string"), 7, "0")).alias("number"), item.alias("_item"), family.alias("category"),
        F.when(u("link") >= UNLINKED, item).alias("ci_key"), weighted(((1, 0.04), (2, 0.12), (3, 0.5), (4, 0.34)), u("priority")).alias("priority"),
        opened.alias("opened_at"), minutes.alias("_minutes"), (u("repeat") < REPEATS).alias("_repeat"), (u("paste") < PASTED).alias("_paste"), u("words").alias("_w"), (u("related") < RELATED).alias("_related"), u("which").alias("_which"),
    )
    end = F.least(F.col("opened_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_minutes").cast("int")), F.lit(AS_OF).cast("timestamp_ntz"))
    before = F.lag("number").over(Window.partitionBy("_item", "category").orderBy("opened_at", "number"))
    told = F.concat(F.lit("Since "), F.date_format("opened_at", "HH:mm"), F.lit(" users of "), F.when(F.col("ci_key").isNotNull(), F.col("ci_key")).otherwise(F.lit("an unknown system")), F.lit(" report "), F.col("category"), F.lit(" trouble; first noticed by team "), F.floor(F.col("_w") * 900).cast("string"), F.lit(", who restarted their client, cleared the cache and tried another network without any change in what they see, reference "), F.hex(F.col("id")))
    related = F.when(F.col("_other").isNotNull(), F.concat(F.lit("\n\nPossibly related to "), F.col("_other"), F.lit(", similar symptoms."))).otherwise(F.lit(""))
    return _with_related(rows).select(
        "number", F.concat(F.col("category"), F.lit(" trouble")).alias("short_description"),
        F.concat(told, F.when(F.col("_paste"), F.concat(F.lit("\nERROR at worker "), F.hex(F.xxhash64("id")))).otherwise(F.lit("")), related).alias("description"),
        "ci_key", "category", "priority", "opened_at", F.when(end < F.lit(AS_OF).cast("timestamp_ntz"), end).alias("resolved_at"),
        F.concat(F.lit("group"), (F.abs(F.xxhash64("category")) % 9).cast("string")).alias("assignment_group"),
        F.when(F.col("_repeat"), before).alias("duplicate_of"),
    )


def _with_related(rows: DataFrame) -> DataFrame:
    """rows with _other: for related ones the number of one of the last POOL of the family, by time.

    Places in a family are counted by day first, so that no family is ranked in one task; which place is
    meant is then a number, and finding it a join.
    """
    day = F.to_date("opened_at")
    days = rows.groupBy("category", day.alias("_day")).agg(F.count("*").alias("_c"))
    before = days.withColumn("_before", F.sum("_c").over(Window.partitionBy("category").orderBy("_day")) - F.col("_c")).drop("_c")
    within = F.row_number().over(Window.partitionBy("category", "_day").orderBy("opened_at", "number"))
    placed = rows.withColumn("_day", day).withColumn("_in", within).join(before, ["category", "_day"]).withColumn("_place", F.col("_before") + F.col("_in"))
    wanted = F.when(F.col("_related") & (F.col("_place") > 1), F.col("_place") - 1 - F.floor(F.col("_which") * F.least(F.col("_place") - 1, F.lit(POOL))).cast("long"))
    pool = placed.select("category", F.col("_place").alias("_wanted"), F.col("number").alias("_other"))
    return placed.withColumn("_wanted", wanted).join(pool, ["category", "_wanted"], "left")


def changes(spark: SparkSession, services: int, n: int, seed: int, incident_share: float = 0.15, incidents_: DataFrame | None = None) -> DataFrame:
    """Changes with planned and actual times, one in seven never begun. With incidents (number, ci_key, opened_at) some, where there is one, were raised after the last incident on their item before them."""
    u = lambda slot: uniform(seed, "chg" + slot, "id")
    start = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((2 + F.floor(u("date") * 700)).cast("int"), F.floor(u("hour") * 24).cast("int"))
    planned = 30 + F.floor(u("plan") * 240)
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    begun = u("begun") >= 1 / 7
    made = spark.range(n).select(
        F.concat(F.lit("CHG"), F.lpad((F.col("id") + 1_000_000).cast("string"), 7, "0")).alias("number"),
        F.concat(F.lit("Update of "), chosen(DOMAINS, u("domain"))).alias("short_description"), F.lit("Planned work").alias("description"),
        F.concat(F.lit("svc-"), F.lpad(F.floor(u("item") * services).cast("long").cast("string"), 6, "0")).alias("ci_key"),
        weighted((("normal", 0.7), ("standard", 0.2), ("emergency", 0.1)), u("type")).alias("change_type"), weighted((("low", 0.5), ("moderate", 0.35), ("high", 0.15)), u("risk")).alias("risk"),
        start.alias("planned_start"), (start + minutes(planned)).alias("planned_end"),
        F.when(begun, start).alias("actual_start"), F.when(begun, start + minutes(planned * (0.6 + u("run")))).alias("actual_end"),
        F.when(u("code") < 0.9, "successful").otherwise("unsuccessful").alias("close_code"),
        (u("after") < incident_share).alias("_after"),
    )
    if incidents_ is None:
        return made.withColumn("raised_after_incident", F.lit(None).cast("string")).drop("_after")
    own = incidents_.where("ci_key is not null").select("ci_key", F.col("number").alias("_number"), "opened_at")
    before = made.where("_after").select("number", "ci_key", "planned_start").join(own, "ci_key").where("opened_at < planned_start")
    last = before.groupBy("number").agg(F.max_by("_number", F.struct("opened_at", "_number")).alias("raised_after_incident"))
    return made.drop("_after").join(last, "number", "left")


def problems(incidents_: DataFrame, seed: int) -> DataFrame:
    """A problem for each item and family with two or more incidents."""
    rows = incidents_.where("ci_key is not null").groupBy("ci_key", "category").agg(F.count("*").alias("n"), F.min("opened_at").alias("opened_at"), F.max("resolved_at").alias("_last"), F.array_sort(F.collect_list("number")).alias("incident_numbers")).where("n >= 2")
    return rows.select(F.concat_ws("-", F.lit("PRB"), "ci_key", "category").alias("number"), F.concat(F.lit("Repeated "), F.col("category")).alias("short_description"), "ci_key", "category", "opened_at", F.when(uniform(seed, "open", "ci_key", "category") < 0.7, F.col("_last")).alias("resolved_at"), F.concat(F.lit("Restart "), F.col("ci_key")).alias("workaround"), "incident_numbers")


def articles(problems_: DataFrame) -> DataFrame:
    """An article for each resolved problem, in sections."""
    body = F.concat(F.lit("# "), F.col("short_description"), F.lit("\n## Symptom\nUsers report "), F.col("category"), F.lit(" trouble on "), F.col("ci_key"), F.lit("\n## Cause\nKnown and described in "), F.col("number"), F.lit("\n## Fix\n"), F.col("workaround"), F.lit(" and watch it for an hour"))
    return problems_.where("resolved_at is not null").select(F.concat(F.lit("KB-"), F.col("number")).alias("number"), F.col("number").alias("problem_number"), "category", F.col("resolved_at").alias("published_at"), body.alias("text"))
