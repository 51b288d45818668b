"""Time predicates as column expressions. The session's time zone is UTC; `as_of` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def out_of_hours(at: str | Column) -> Column:
    """At a weekend, before 8 or from 18 o'clock."""
    return (F.weekday(at) >= 5) | (F.hour(at) < 8) | (F.hour(at) >= 18)


def month_before(at: str | Column, as_of: Column) -> Column:
    """In the calendar month before as_of's."""
    return F.date_trunc("month", at) == F.add_months(F.date_trunc("month", as_of), -1).cast("timestamp_ntz")


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return F.timestamp_diff("SECOND", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def month_name(at: str | Column) -> Column:
    return F.date_format(at, "MMMM yyyy")
