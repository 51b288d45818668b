"""Folds along arrays as column expressions, which never cost the square of an array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(values: Column) -> Column:
    """An array cut into arrays of the square root of its size."""
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    return let(wide, lambda w: F.transform(F.filter(F.sequence(F.lit(0), w), lambda k: k * w < F.size(values)), lambda k: F.slice(values, k * w + 1, w)))


def running(values: Column, neutral: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Of each value, the fold of all up to it; both is associative."""
    within = F.transform(chunks(values), lambda c: F.transform(c, lambda _, j: F.aggregate(F.slice(c, F.lit(1), j + 1), neutral, both)))
    before = lambda w: F.transform(w, lambda _, k: F.aggregate(F.slice(w, F.lit(1), k), neutral, lambda a, x: both(a, F.element_at(x, -1))))
    return let(within, lambda w: F.flatten(F.zip_with(before(w), w, lambda b, own: F.transform(own, lambda x: both(b, x)))))
