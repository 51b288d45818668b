"""A question turned into SQL by any function of a prompt, guarded before it runs.

The function's reply is searched for a query; Spark's own parser says what that is, and nodes of its
plan may only read. It is analysed before it is run, so invented tables and columns are found. What went wrong is told to the
function, which may try again.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.S | re.I)
_START = re.compile(r"\b(?:select|with)\b.*", re.S | re.I)
#: The nodes of a parsed plan that only read, by the names of their classes.
READS = frozenset("""
Project Filter Join LateralJoin AsOfJoin Aggregate Distinct Deduplicate Union Intersect Except Sort GlobalLimit LocalLimit Limit Offset Tail Sample Window WithWindowDefinition Pivot Unpivot
Generate Expand GroupingSets SubqueryAlias View OneRowRelation LocalRelation UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable
UnresolvedTableValuedFunction UnresolvedPivot UnresolvedUnpivot UnresolvedHint PipeOperator UnresolvedJoin UnresolvedQualify
""".split())
#: Expressions that hold a plan.
SUBQUERIES = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"})
#: Functions that run code of the machine or tell of it, and those that make tables of nothing stored that a query needs.
FORBIDDEN = frozenset({"reflect", "try_reflect", "java_method", "current_user", "session_user", "user", "input_file_name"})
TABLE_FUNCTIONS = frozenset({"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "range"})
#: A recursive query says how deep it goes at most, and that isn't deeper than LEVELS.
LEVELS = 10


class Refused(ValueError):
    """The query may not be run."""


def extracted(reply: str) -> str:
    """The query in a reply: what is fenced, else from the first SELECT or WITH on."""
    fenced = _FENCE.search(reply)
    found = fenced[1] if fenced else (m[0] if (m := _START.search(reply)) else "")
    return found.strip().rstrip(";").strip()


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(found: list) -> Iterator:
    """The expressions and what stands below them."""
    while found:
        e = found.pop()
        yield e
        found.extend(_each(e.children()))


def _nodes(plan) -> Iterator:
    """A parsed plan's nodes, those of its subqueries and named queries too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _each(node.children())
        if _kind(node) == "UnresolvedWith":
            todo += [named._2() for named in _each(node.cteRelations())]
        todo += [e.plan() for e in _expressions(_each(node.expressions())) if _kind(e) in SUBQUERIES]


def guarded(spark: SparkSession, query: str) -> str:
    """The query, if Spark's parser takes it for one statement and its plan only reads tables, with bounded recursion; else an error that says why.

    What a query is called or says in strings, names and comments doesn't count: just nodes of its plan.
    Files by their path are relations of two names, the first of which is no database.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except PySparkException as wrong:
        raise Refused(f"this isn't one statement: {str(wrong).strip().splitlines()[0]}") from wrong
    for node in _nodes(plan):
        kind = _kind(node)
        if kind not in READS:
            raise Refused(f"{kind} isn't allowed: queries only read")
        if kind == "UnresolvedRelation":
            name = _each(node.multipartIdentifier())
            if len(name) > 1 and not spark.catalog.databaseExists(".".join(f"`{n}`" for n in name[:-1])):
                raise Refused(f"{'.'.join(name)} is no table; files can't be read by their path")
        if kind == "UnresolvedTableValuedFunction" and (name := _each(node.name())[-1].lower()) not in TABLE_FUNCTIONS:
            raise Refused(f"{name} isn't allowed as a table")
        if kind == "UnresolvedWith" and node.allowRecursion():
            for named in _each(node.cteRelations()):
                if not (named._3().isDefined() and named._3().get() <= LEVELS):
                    raise Refused(f"a recursive query must say MAX RECURSION LEVEL n, with n up to {LEVELS}")
        for e in _expressions(_each(node.expressions())):
            if _kind(e) == "UnresolvedFunction" and (name := _each(e.nameParts())[-1].lower()) in FORBIDDEN:
                raise Refused(f"{name} isn't allowed")
    return query


def schema(spark: SparkSession, names: list[str]) -> str:
    """The tables and their columns, for a prompt."""
    return "\n".join(f"{n}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.table(n).schema)})" for n in names)


def planned(spark: SparkSession, query: str, most: int = 80) -> DataFrame:
    """The guarded query, analysed but not run, and bounded to `most` rows."""
    df = spark.sql(guarded(spark, query))
    df.schema  # noqa: B018  analysis
    return df.limit(most)


def run(df: DataFrame, seconds: float) -> list:
    """The rows; after so many seconds its jobs are cancelled, which is an error."""
    context, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "generated query", True)
    timer = threading.Timer(seconds, context.cancelJobGroup, [group])
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()


def answered(spark: SparkSession, question: str, tables: list[str], ask: Callable[[str], str], attempts: int = 3, seconds: float = 30) -> tuple[list[str], str, str | None, int]:
    """Every string the query gives, the query, the last error if none ran, and how many attempts were repeated."""
    head = f"Tables:\n{schema(spark, tables)}\n\nWrite one Spark SQL SELECT that answers: {question}"
    prompt, query, error = head, "", None
    for attempt in range(attempts):
        query = extracted(ask(prompt))
        try:
            rows = run(planned(spark, query), seconds)
            return list(dict.fromkeys(str(v) for r in rows for v in r if isinstance(v, str))), query, None, attempt
        except (Refused, PySparkException) as wrong:
            error = str(wrong).split("\n")[0][:300]
            prompt = f"{head}\n\nThis failed:\n{query}\n{error}\nWrite another."
    return [], query, error, attempts - 1
