"""The star-schema and event tables seen as an IT estate: items, dependency edges, incidents, changes, problems, articles.

Impact flows from child to parent: the parent depends on the child. Orders depend on customers, customers
and suppliers run on nations, nations are hosted on regions; parts managed by suppliers carry no impact.
Error events are incidents on the user's item, purchases are changes to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
EDGES_AS_OF = "2002-01-01 00:00:00"
# The relationship types that carry impact, by the name of their parent's side.
IMPACT = ("Depends on", "Runs on", "Hosted on")
GROUPS = ("Automobile Support", "Building Support", "Furniture Support", "Household Support", "Machinery Support")
CATEGORIES = ("capacity", "latency", "replication", "certificate", "access")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """key, name, cls, environment, domain."""
    stage = lambda when: F.when(F.expr(when), "dev").otherwise("prd").alias("environment")
    row = lambda kind, k, name, cls, env, domain: (key(kind, k).alias("key"), name.alias("name"), F.lit(cls).alias("cls"), env, domain.alias("domain"))
    parts = [
        table(spark, d, "region").select(*row("region", "r_regionkey", F.col("r_name"), "cmdb_ci_cluster", stage("false"), F.lit("platform"))),
        table(spark, d, "nation").select(*row("nation", "n_nationkey", F.col("n_name"), "cmdb_ci_lb", stage("false"), F.lit("network"))),
        table(spark, d, "customer").select(*row("customer", "c_custkey", F.col("c_name"), "cmdb_ci_service", stage("c_custkey % 3 = 0"), F.lower("c_mktsegment"))),
        table(spark, d, "supplier").select(*row("supplier", "s_suppkey", F.col("s_name"), "cmdb_ci_server", stage("s_suppkey % 4 = 0"), F.lit("supply"))),
        table(spark, d, "orders").select(*row("order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "cmdb_ci_appl", stage("o_orderstatus = 'P'"), F.lower("o_orderpriority"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, child, type_name, last_discovered, impact; one row for each (child, parent, type)."""
    none = F.lit(None).cast("timestamp_ntz").alias("last_discovered")
    row = lambda p, c, t, seen: (p.alias("parent"), c.alias("child"), F.lit(t).alias("type_name"), seen)
    orders = table(spark, d, "orders")
    seen = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_discovered"))
    customers = table(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    managed = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = table(spark, d, "nation").select(*row(key("nation", "n_nationkey"), key("region", "n_regionkey"), "Hosted on::Hosts", none))
    out = out.unionByName(customers.select(*row(key("customer", "c_custkey"), key("nation", "c_nationkey"), "Runs on::Runs", F.col("last_discovered"))))
    out = out.unionByName(table(spark, d, "supplier").select(*row(key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "Runs on::Runs", none)))
    out = out.unionByName(orders.select(*row(key("order", "o_orderkey"), key("customer", "o_custkey"), "Depends on::Used by", F.col("o_orderdate").alias("last_discovered"))))
    out = out.unionByName(managed.select(*row(key("part", "l_partkey"), key("supplier", "l_suppkey"), "Managed by::Manages", none)))
    return out.withColumn("impact", F.split_part("type_name", F.lit("::"), F.lit(1)).isin(*IMPACT))


def supports(spark: SparkSession, d: str) -> DataFrame:
    """The edges that carry impact, as (src, dst): from what supports to what is supported."""
    return edges(spark, d).where("impact").select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def _numbered(prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(F.col("event_id").cast("string"), 7, "0"))


def incidents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"), F.lit(0))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % 5 + 1).cast("int"))
    alike = Window.partitionBy("user_id", F.col("event_id") % 5).orderBy("ts", "event_id")
    group = F.element_at(F.array(*map(F.lit, GROUPS)), (F.col("user_id") % 5 + 1).cast("int"))
    near = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(", near NATION_"), (F.col("event_id") % 25).cast("string"))).otherwise(F.lit(""))
    return e.select(
        _numbered("INC").alias("number"),
        F.concat(category, F.lit(" trouble on item "), F.col("user_id").cast("string")).alias("short_description"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit(" reports "), category, F.when(F.col("event_id") % 9 == 0, F.concat(F.lit(", as in INC"), F.lpad((F.col("event_id") / 2).cast("long").cast("string"), 7, "0"))).otherwise(F.lit(""))).alias("description"),
        F.when(F.col("k") % 6 != 0, key("customer", "user_id")).alias("ci_key"),
        category.alias("category"),
        (F.col("event_id") % 4 + 1).cast("int").alias("priority"),
        F.col("ts").alias("opened_at"),
        F.when(F.col("k") % 5 != 0, F.col("ts") + minutes).alias("resolved_at"),
        F.when(F.col("k") % 4 == 0, F.lit("Service Desk")).otherwise(group).alias("assignment_group"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("caller"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("fixed by restart after "), F.floor("value").cast("string"), F.lit(" minutes"))).alias("close_notes"),
        F.array(F.struct(F.col("ts").alias("at"), group.alias("author"), F.concat(F.lit("seen on "), key("customer", "user_id"), near).alias("text")), F.struct((F.col("ts") + minutes).alias("at"), F.lit("desk").alias("author"), F.when(F.col("k") % 3 == 0, "").otherwise("watched, no change").alias("text"))).alias("work_notes"),
        F.lag(_numbered("INC")).over(alike).alias("duplicate_of"),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as changes. A tenth, if they are to the user's own item, were raised after the last linked incident on it before them, where there is one."""
    both = table(spark, d, "events").where("event_type in ('error', 'purchase')").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    fault = F.last(F.when((F.col("event_type") == "error") & (F.col("k") % 6 != 0), F.col("event_id")), ignorenulls=True).over(earlier)
    e = both.withColumn("last_error", fault).where("event_type = 'purchase'")
    minutes = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), x.cast("int"), F.lit(0))
    planned = F.floor("value") + 10
    return e.select(
        _numbered("CHG").alias("number"),
        F.concat(F.lit("Change to item "), F.col("user_id").cast("string")).alias("short_description"),
        F.concat(F.lit("Planned work, step "), F.col("k").cast("string")).alias("description"),
        F.when(F.col("k") % 8 == 1, F.concat(F.lit("nation:"), (F.col("event_id") % 25).cast("string"))).when(F.col("k") % 8 == 2, F.concat(F.lit("order:"), (F.col("event_id") % 1000).cast("string"))).otherwise(key("customer", "user_id")).alias("ci_key"),
        F.when(F.col("k") % 10 == 0, "emergency").otherwise("normal").alias("change_type"),
        F.element_at(F.array(F.lit("low"), F.lit("moderate"), F.lit("high")), (F.col("k") % 3 + 1).cast("int")).alias("risk"),
        F.col("ts").alias("planned_start"),
        (F.col("ts") + minutes(planned)).alias("planned_end"),
        F.when(F.col("k") % 7 != 0, F.col("ts")).alias("actual_start"),
        F.when(F.col("k") % 7 != 0, F.col("ts") + minutes(F.floor(planned * (F.col("k") % 5) / 2))).alias("actual_end"),
        F.when(F.col("k") % 4 == 0, "unsuccessful").otherwise("successful").alias("close_code"),
        F.when((F.col("k") % 10 == 0) & ~(F.col("k") % 8).isin(1, 2), F.concat(F.lit("INC"), F.lpad(F.col("last_error").cast("string"), 7, "0"))).alias("raised_after_incident"),
    )


def problems(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of one item and category, where there are two or more, in one problem."""
    own = incidents(spark, d).where("ci_key is not null")
    grouped = own.groupBy("ci_key", "category").agg(F.count("*").alias("n"), F.min("opened_at").alias("opened_at"), F.max("resolved_at").alias("last_resolved"), F.array_sort(F.collect_list("number")).alias("incident_numbers")).where("n >= 2")
    return grouped.select(
        F.concat(F.lit("PRB-"), F.col("ci_key"), F.lit("-"), F.col("category")).alias("number"),
        F.concat(F.lit("Repeated "), F.col("category"), F.lit(" on "), F.col("ci_key")).alias("short_description"),
        "ci_key", "category", "opened_at",
        F.when(F.col("n") % 3 != 0, F.col("last_resolved")).alias("resolved_at"),
        F.concat(F.lit("restart "), F.col("ci_key")).alias("workaround"),
        "incident_numbers",
    )


def articles(spark: SparkSession, d: str) -> DataFrame:
    """A knowledge article for each page: its id, the problem it documents (which need not exist), and its text in sections."""
    p = table(spark, d, "pages")
    about = F.concat(F.lit("PRB-customer:"), (F.col("page_id") % 150).cast("string"), F.lit("-"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("page_id") % 5 + 1).cast("int")))
    return p.select(F.concat(F.lit("KB"), F.lpad(F.col("page_id").cast("string"), 6, "0")).alias("number"), about.alias("problem_number"), "url", F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit("\n## Symptom\nSeen at "), F.col("url"), F.lit("\n## Fix\nok\n## Background\n"), F.substring("html", 1, 200)).alias("text"))


#: The same views for DuckDB, by name; a view may use those before it.
VIEWS = {
    "items": """SELECT 'region:' || r_regionkey AS key, r_name AS name, 'cmdb_ci_cluster' AS cls, 'prd' AS environment, 'platform' AS domain FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'cmdb_ci_lb', 'prd', 'network' FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, c_name, 'cmdb_ci_service', CASE WHEN c_custkey % 3 = 0 THEN 'dev' ELSE 'prd' END, lower(c_mktsegment) FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'cmdb_ci_server', CASE WHEN s_suppkey % 4 = 0 THEN 'dev' ELSE 'prd' END, 'supply' FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'cmdb_ci_appl', CASE WHEN o_orderstatus = 'P' THEN 'dev' ELSE 'prd' END, lower(o_orderpriority) FROM orders""",
    "edges": """SELECT *, split_part(type_name, '::', 1) IN ('Depends on', 'Runs on', 'Hosted on') AS impact FROM (
        SELECT 'nation:' || n_nationkey AS parent, 'region:' || n_regionkey AS child, 'Hosted on::Hosts' AS type_name, CAST(NULL AS timestamp) AS last_discovered FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'Runs on::Runs', (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Runs on::Runs', NULL FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'Depends on::Used by', o_orderdate FROM orders
        UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'Managed by::Manages', CAST(NULL AS timestamp) FROM lineitem)""",
    "supports": "SELECT child AS src, parent AS dst FROM edges WHERE impact",
    "incidents": """SELECT 'INC' || lpad(event_id::varchar, 7, '0') AS number, category || ' trouble on item ' || user_id AS short_description,
        'Customer#' || lpad(user_id::varchar, 9, '0') || ' reports ' || category || CASE WHEN event_id % 9 = 0 THEN ', as in INC' || lpad((event_id // 2)::varchar, 7, '0') ELSE '' END AS description,
        CASE WHEN k % 6 <> 0 THEN 'customer:' || user_id END AS ci_key, category, (event_id % 4 + 1)::int AS priority, ts AS opened_at,
        CASE WHEN k % 5 <> 0 THEN ts + to_minutes(floor(value)::bigint) END AS resolved_at,
        CASE WHEN k % 4 = 0 THEN 'Service Desk' ELSE ['Automobile', 'Building', 'Furniture', 'Household', 'Machinery'][user_id % 5 + 1] || ' Support' END AS assignment_group, 'user' || user_id AS caller,
        CASE WHEN k % 5 <> 0 THEN 'fixed by restart after ' || floor(value)::bigint || ' minutes' END AS close_notes,
        ['seen on customer:' || user_id || CASE WHEN event_id % 4 = 0 THEN ', near NATION_' || (event_id % 25) ELSE '' END, CASE WHEN k % 3 = 0 THEN '' ELSE 'watched, no change' END] AS notes,
        lag('INC' || lpad(event_id::varchar, 7, '0')) OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS duplicate_of
        FROM (SELECT *, json_extract(props, '$.k')::int AS k, ['capacity', 'latency', 'replication', 'certificate', 'access'][event_id % 5 + 1] AS category FROM events WHERE event_type = 'error')""",
    "changes": """SELECT 'CHG' || lpad(event_id::varchar, 7, '0') AS number, 'Change to item ' || user_id AS short_description, 'Planned work, step ' || k AS description, CASE WHEN k % 8 = 1 THEN 'nation:' || (event_id % 25) WHEN k % 8 = 2 THEN 'order:' || (event_id % 1000) ELSE 'customer:' || user_id END AS ci_key,
        CASE WHEN k % 10 = 0 THEN 'emergency' ELSE 'normal' END AS change_type, ['low', 'moderate', 'high'][k % 3 + 1] AS risk, ts AS planned_start,
        ts + to_minutes((floor(value) + 10)::bigint) AS planned_end, CASE WHEN k % 7 <> 0 THEN ts END AS actual_start,
        CASE WHEN k % 7 <> 0 THEN ts + to_minutes(floor((floor(value) + 10) * (k % 5) / 2)::bigint) END AS actual_end,
        CASE WHEN k % 4 = 0 THEN 'unsuccessful' ELSE 'successful' END AS close_code, CASE WHEN k % 10 = 0 AND k % 8 NOT IN (1, 2) THEN 'INC' || lpad(last_error::varchar, 7, '0') END AS raised_after_incident
        FROM (SELECT *, last_value(CASE WHEN event_type = 'error' AND k % 6 <> 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error
            FROM (SELECT *, json_extract(props, '$.k')::int AS k FROM events WHERE event_type IN ('error', 'purchase'))) WHERE event_type = 'purchase'""",
    "problems": """SELECT 'PRB-' || ci_key || '-' || category AS number, 'Repeated ' || category || ' on ' || ci_key AS short_description, ci_key, category, opened_at,
        CASE WHEN n % 3 <> 0 THEN last_resolved END AS resolved_at, 'restart ' || ci_key AS workaround, incident_numbers
        FROM (SELECT ci_key, category, count(*) AS n, min(opened_at) AS opened_at, max(resolved_at) AS last_resolved, list(number ORDER BY number) AS incident_numbers FROM incidents WHERE ci_key IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)""",
    "articles": """SELECT 'KB' || lpad(page_id::varchar, 6, '0') AS number, 'PRB-customer:' || (page_id % 150) || '-' || ['capacity', 'latency', 'replication', 'certificate', 'access'][page_id % 5 + 1] AS problem_number, url, 'Page ' || page_id || chr(10) || '## Symptom' || chr(10) || 'Seen at ' || url || chr(10) || '## Fix' || chr(10) || 'ok' || chr(10) || '## Background' || chr(10) || substring(html, 1, 200) AS text FROM pages""",
}


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the views named, and those they use, before the body."""
    uses = {"supports": ("edges",), "problems": ("incidents",)}
    want = {n for name in names for n in (name, *uses.get(name, ()))}
    views = ",\n".join(f"{n} AS ({sql})" for n, sql in VIEWS.items() if n in want)
    first, _, rest = body.partition("WITH ") if body.startswith("WITH ") else ("", "", body)
    more = rest if body.startswith("WITH ") else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + views + (",\n" + more if more is not None else "\n" + body)
