"""Reductions and thresholds over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def argmax(v: str) -> Column:
    """Index (from 0) of the first largest element."""
    return F.array_position(F.col(v), F.array_max(v)) - 1


def first_at_least(v: str, t: float) -> Column:
    """Index of the first element of at least ``t``; -1 without one."""
    return F.array_position(F.transform(v, lambda x: x >= t), True) - 1


def last_at_least(v: str, t: float) -> Column:
    """Index of the last element of at least ``t``; -1 without one."""
    back = F.array_position(F.transform(F.reverse(v), lambda x: x >= t), True)
    return F.when(back == 0, F.lit(-1)).otherwise(F.size(v) - back)


def first_at_most(v: str, t: float) -> Column:
    return F.array_position(F.transform(v, lambda x: x <= t), True) - 1
