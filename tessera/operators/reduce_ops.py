"""Reduction operators: an aggregate of many rows and the same operation on two values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReduceOp:
    """``many`` aggregates a value column (with the index for order), ``two`` combines two values."""

    name: str
    many: Callable[[Column, Column], Column]
    two: Callable[[Column, Column], Column]


def _product(v: Column, g: Column) -> Column:
    """A double, exact for whole numbers below 2**53."""
    return F.product(v)


PLUS = ReduceOp("plus", lambda v, g: F.sum(v), lambda a, b: a + b)
MULTIPLY = ReduceOp("multiply", _product, lambda a, b: a * b)
MIN = ReduceOp("min", lambda v, g: F.min(v), lambda a, b: F.least(a, b))
MAX = ReduceOp("max", lambda v, g: F.max(v), lambda a, b: F.greatest(a, b))
BIT_AND = ReduceOp("bit_and", lambda v, g: F.bit_and(v), lambda a, b: a.bitwiseAND(b))
BIT_OR = ReduceOp("bit_or", lambda v, g: F.bit_or(v), lambda a, b: a.bitwiseOR(b))
BIT_XOR = ReduceOp("bit_xor", lambda v, g: F.bit_xor(v), lambda a, b: a.bitwiseXOR(b))
FIRST = ReduceOp("first", lambda v, g: F.min_by(v, g), lambda a, b: a)
SECOND = ReduceOp("second", lambda v, g: F.max_by(v, g), lambda a, b: b)
LOGICAL_AND = ReduceOp("logical_and", lambda v, g: F.bool_and(v.cast("boolean")), lambda a, b: a & b)
LOGICAL_OR = ReduceOp("logical_or", lambda v, g: F.bool_or(v.cast("boolean")), lambda a, b: a | b)
LOGICAL_XOR = ReduceOp("logical_xor", lambda v, g: F.pmod(F.count_if(v.cast("boolean")), F.lit(2)) == 1, lambda a, b: a != b)
OPS = {op.name: op for op in (PLUS, MULTIPLY, MIN, MAX, BIT_AND, BIT_OR, BIT_XOR, FIRST, SECOND, LOGICAL_AND, LOGICAL_OR, LOGICAL_XOR)}


def custom(zero: Column, step: Callable[[Column, Column], Column], name: str = "custom") -> ReduceOp:
    """An operator of one's own, folded in the order of the index. The rows of a group meet in one task, so groups
    must be small; associative operations are better written as ``many`` directly."""

    def many(v: Column, g: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(g.alias("g"), v.alias("v"))))
        return F.aggregate(rows, zero, lambda acc, x: step(acc, x["v"]))

    return ReduceOp(name, many, step)
