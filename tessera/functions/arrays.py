"""Expressions on array columns and numbers: selection, rearrangement and folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def drop(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def head(a: Column) -> Column:
    return F.get(a, F.lit(0))


def tail(a: Column) -> Column:
    return drop(a, 1)


def append(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def replace_nth(a: Column, n: int, x: Column) -> Column:
    return F.transform(a, lambda v, i: F.when(i == n, x).otherwise(v))


def split_at(a: Column, n: int) -> Column:
    return F.struct(take(a, n).alias("left"), drop(a, n).alias("right"))


def transform(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def accumulate(a: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, zero, op)


def inner_product(a: Column, b: Column, zero: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, v: s + v)


#: Operations of folds.
FOLDS: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiplies": lambda a, b: a * b,
    "divides": lambda a, b: a / b,
    "power": lambda a, b: F.pow(a, b),
    "minimum": lambda a, b: F.least(a, b),
    "maximum": lambda a, b: F.greatest(a, b),
}


def fold(a: Column, op: str, zero: Column) -> Column:
    """zero op a[0] op a[1] ..., from the left."""
    return F.aggregate(a, zero, FOLDS[op])


def div_ceil(a: Column, b: Column) -> Column:
    """Quotient rounded up, of non-negative integers."""
    return F.call_function("div", a + b - 1, b)
