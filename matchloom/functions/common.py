"""Small numeric column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def r4(c: Column) -> Column:
    """Round half up to four digits."""
    return F.floor(c * 10000.0 + 0.5) / F.lit(10000.0)


def r1(c: Column) -> Column:
    return F.floor(c * 10.0 + 0.5) / F.lit(10.0)


def pct(num: Column, den: Column) -> Column:
    """Percentage with one digit, 0 where the denominator is 0."""
    return F.when(den > 0, r1(num * F.lit(100.0) / den)).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    """Conditional count as a bigint (map-side combined)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def idiv(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(float(n))).cast("bigint")


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def sq_dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def metres(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def switch(arms, default=None) -> Column:
    """First matching arm of (condition, value) pairs."""
    head, *tail = arms
    c = reduce(lambda acc, a: acc.when(a[0], a[1]), tail, F.when(head[0], head[1]))
    return c if default is None else c.otherwise(default)


def codes(*arms) -> Column:
    """Array of the codes whose condition holds, in order, nulls dropped."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in arms]))
