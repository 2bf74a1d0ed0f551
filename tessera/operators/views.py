"""Views: parts of arrays under indices of their own. All are lazy filters and projections.

A view has the columns of its array and ``gidx``, the linear index in the array it came from; its own indices start
at zero. `origin` leads back to the array."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.array import GridArray
from tessera.plans.patterns import Pattern, coords_of, long


def _with_gidx(a: GridArray) -> DataFrame:
    return a.df if "gidx" in a.df.columns and a.ndim > 1 or a.ndim == 1 else a.df.withColumn("gidx", a.gidx())


def sub(a: GridArray, begin: int, end: int, dim: int = 0) -> GridArray:
    """The half-open range of a dimension, counted from zero."""
    extents = list(a.pattern.extents)
    begin, end = max(0, begin), min(end, extents[dim])
    extents[dim] = max(0, end - begin)
    if a.ndim == 1:
        df = a.df if "vidx" in a.df.columns else a.df.withColumn("vidx", F.col("gidx"))
        df = df.where((F.col("vidx") >= begin) & (F.col("vidx") < end)).withColumn("vidx", F.col("vidx") - begin)
    else:
        name = f"i{dim}"
        df = _with_gidx(a).where((F.col(name) >= begin) & (F.col(name) < end)).withColumn(name, F.col(name) - begin)
    return GridArray(df, Pattern.of(extents, order=a.pattern.order), a, lambda x: sub(x, begin, end, dim))


@dataclass(frozen=True)
class ViewSpec:
    """Offsets and extents of a rectangle of cells."""

    offsets: tuple[int, ...]
    extents: tuple[int, ...]

    @classmethod
    def of(cls, extents: tuple[int, ...]) -> ViewSpec:
        return cls((0,) * len(extents), tuple(extents))

    @property
    def size(self) -> int:
        return math.prod(self.extents)

    def resize(self, dim: int, extent: int) -> ViewSpec:
        """As many cells of a dimension from the same offset on."""
        return replace(self, extents=(*self.extents[:dim], extent, *self.extents[dim + 1 :]))

    def slice(self, dim: int, offset: int, extent: int) -> ViewSpec:
        """A part of a dimension, counted from the rectangle's own offset."""
        offset, extent = min(offset, self.extents[dim]), max(0, min(extent, self.extents[dim] - offset))
        moved = (*self.offsets[:dim], self.offsets[dim] + offset, *self.offsets[dim + 1 :])
        return ViewSpec(moved, self.extents).resize(dim, extent)

    def view(self, a: GridArray) -> GridArray:
        for d, (o, e) in enumerate(zip(self.offsets, self.extents)):
            a = sub(a, o, o + e, d)
        return a


def section(a: GridArray, dim: int, at: int) -> GridArray:
    """One index of a dimension; the dimension goes."""
    df = _with_gidx(a).where(F.col(f"i{dim}") == at)
    kept = [d for d in range(a.ndim) if d != dim]
    names = ["vidx"] if len(kept) == 1 else [f"i{k}" for k in range(len(kept))]
    out = df.select(*(F.col(f"i{d}").alias(n) for d, n in zip(kept, names)), "gidx", "value")
    return GridArray(out, Pattern.of([a.pattern.extents[d] for d in kept]), a, lambda x: section(x, dim, at))


def row(a: GridArray, n: int) -> GridArray:
    return section(a, 0, n)


def col(a: GridArray, n: int) -> GridArray:
    return section(a, 1, n)


def rows(a: GridArray, offset: int, extent: int) -> GridArray:
    return sub(a, offset, offset + extent, 0)


def cols(a: GridArray, offset: int, extent: int) -> GridArray:
    return sub(a, offset, offset + extent, 1)


def local(a: GridArray, unit: int) -> DataFrame:
    """The unit's cells with their places within it."""
    return a.df.where(a.pattern.is_local(a.coords, unit)).withColumn("gidx", a.gidx()).withColumn("lidx", a.pattern.local_index(a.coords))


def blocks(a: GridArray) -> DataFrame:
    """The cells with the number of their block."""
    return a.df.withColumn("block", a.pattern.block_at(a.coords).cast("long"))


def block(a: GridArray, number: int) -> DataFrame:
    """The cells of one block; its bounds reach the scan."""
    out = blocks(a).where(F.col("block") == number)
    for c, (begin, end) in zip(a.coords, a.pattern.block_bounds(number)):
        out = out.where((c >= long(begin)) & (c < long(end)))
    return out


def index(a: GridArray) -> DataFrame:
    """The indices of a view in its origin."""
    return _with_gidx(a).select("gidx")


def origin(a: GridArray) -> GridArray:
    while a.origin is not None:
        a = a.origin
    return a


def domain(a: GridArray) -> GridArray:
    return a.origin or a


def apply(view: GridArray, a: GridArray) -> GridArray:
    """The view's steps, from its origin on, taken on another array."""
    if view.origin is None or view.made is None:
        return a
    return view.made(apply(view.origin, a))


def intersect(a: GridArray, b: GridArray) -> GridArray:
    """The cells of ``a`` whose index ``b`` has too."""
    return replace(a, df=_with_gidx(a).join(index(b), "gidx", "left_semi"))


def difference(a: GridArray, b: GridArray) -> GridArray:
    return replace(a, df=_with_gidx(a).join(index(b), "gidx", "left_anti"))


def union(*views: GridArray) -> DataFrame:
    """gidx and value of all cells that one of the views has."""
    out = _with_gidx(views[0]).select("gidx", "value")
    for v in views[1:]:
        out = out.unionByName(_with_gidx(v).select("gidx", "value"))
    return out.groupBy("gidx").agg(F.any_value("value").alias("value"))


def combine(*views: GridArray) -> DataFrame:
    """gidx and value of the views' cells one after another, a cell as often as views have it."""
    out = _with_gidx(views[0]).select("gidx", "value")
    for v in views[1:]:
        out = out.unionByName(_with_gidx(v).select("gidx", "value"))
    return out


def strided(a: GridArray, stride: int, first: int = 0) -> GridArray:
    g = a.gidx()
    return replace(a, df=a.df.where((g >= first) & (F.pmod(g - first, long(stride)) == 0)), origin=a, made=lambda x: strided(x, stride, first))


def of_team(a: GridArray, members: tuple[int, ...]) -> DataFrame:
    """The cells of a part of the units."""
    return a.placed().where(F.col("unit").isin(*members))


def local_index_range(a: GridArray, begin: int, end: int, unit: int) -> DataFrame:
    """begin, end: the places within the unit of those of its cells that lie in [begin, end); nulls if none does."""
    own = local(a, unit).where((F.col("gidx") >= begin) & (F.col("gidx") < end))
    return own.agg(F.min("lidx").alias("begin"), (F.max("lidx") + 1).alias("end"))


def cartesian(offset: Column, extents: tuple[int, ...], order: str = "row") -> list[Column]:
    """The coordinates of an offset."""
    return coords_of(offset, extents, order)


def bounds(a: GridArray) -> DataFrame:
    """first, last (exclusive) and size of the view's indices in its origin."""
    return index(a).agg(F.min("gidx").alias("first"), (F.max("gidx") + 1).alias("last"), F.count("*").alias("size"))
