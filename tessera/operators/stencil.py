"""Stencils on grids: weighted sums of neighbours with three kinds of borders for each dimension.

NONE leaves out cells whose stencil leaves the grid, CYCLIC wraps around, CUSTOM takes values from a function of the
coordinates outside. Where a neighbour is outside in several dimensions, NONE counts before CUSTOM before CYCLIC.

The grid is cut into tiles. Each cell goes to its tile, the cells near a tile's border to the tiles beside it too (its
halo), in one shuffle whatever the number of points; a tile is then one row, an array of cells in the order of their
places, in which neighbours stand at fixed distances. Several sweeps take a halo as much wider, and one shuffle.
Stencils along one dimension do the same with blocks and window functions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.array import GridArray
from tessera.operators.reduce_ops import PLUS, ReduceOp
from tessera.plans.patterns import div, long
from tessera.plans.teams import div_ceil
from tessera.session import checkpointed

NONE, CYCLIC, CUSTOM = "NONE", "CYCLIC", "CUSTOM"


@dataclass(frozen=True)
class Point:
    """An offset and the weight of the value there."""

    offset: tuple[int, ...]
    weight: float = 1.0


@dataclass(frozen=True)
class StencilSpec:
    points: tuple[Point, ...]

    @classmethod
    def full(cls, ndim: int, distance: int = 1) -> StencilSpec:
        """The 3**ndim - 1 neighbours at ``distance`` or none in each dimension."""
        return cls(tuple(Point(o) for o in itertools.product((-distance, 0, distance), repeat=ndim) if any(o)))

    @classmethod
    def within(cls, ndim: int, distance: int) -> StencilSpec:
        """All neighbours at up to ``distance`` in each dimension."""
        steps = range(-distance, distance + 1)
        return cls(tuple(Point(o) for o in itertools.product(steps, repeat=ndim) if any(o)))

    def minmax(self, dim: int) -> tuple[int, int]:
        at = [p.offset[dim] for p in self.points]
        return min(0, *at), max(0, *at)

    def total(self) -> tuple[tuple[int, int], ...]:
        return tuple(self.minmax(d) for d in range(len(self.points[0].offset)))


#: Cells along each side of a tile, by the number of dimensions.
TILES = {1: 1 << 12, 2: 64, 3: 16}


# The expressions below are SQL texts: they have many parts, and a text is handed to the JVM in one call.


def _places(x: str, extent: int, size: int, low: int, high: int, cyclic: bool) -> str:
    """The tiles that need index ``x`` of a dimension, each with the index as the tile sees it (beyond the grid where it
    wraps): an array of structs (t, y), null where a tile doesn't; one struct where the own tile is the only one.

    Tile t needs what lies in [t * size + low, t * size + size + high)."""
    count, t = div_ceil(extent, size), f"({x} div {size})"
    place = lambda tile, y: f"named_struct('t', {tile}, 'y', {y})"
    one = lambda there, tile, y: f"if({there} and {tile} >= 0 and {tile} < {count}, {place(tile, y)}, null)"
    needs = lambda tile, y: f"{y} >= {tile} * {size} + {low} and {y} < {tile} * {size} + {size + high}"
    reach_down, reach_up = div_ceil(high, size), div_ceil(-low, size)
    out = [place(t, x)]
    for j in (*range(-reach_down, 0), *range(1, reach_up + 1)):
        tile = f"({t} + {j})"
        out.append(one(needs(tile, x), tile, x))
    alone = f"{x} - {t} * {size} >= {high} and {x} - {t} * {size} < {size + low}"
    if cyclic:
        for k in range(1, div_ceil(-low, extent) + 1):
            y = f"({x} - {k * extent}L)"
            out += [one(f"{y} >= {low} and {needs(f'{j}L', y)}", f"{j}L", y) for j in range(min(count, reach_up))]
        for k in range(1, div_ceil(high, extent) + 1):
            y = f"({x} + {k * extent}L)"
            out += [one(f"{y} < {extent + high} and {needs(f'{j}L', y)}", f"{j}L", y) for j in range(max(0, count - 1 - reach_down), count)]
        alone += f" and {x} < {extent + low} and {x} >= {high}"
    return f"if({alone}, array({out[0]}), array({', '.join(out)}))"


def dealt(a: GridArray, reach: tuple[tuple[int, int], ...], borders: tuple[str, ...], tile: tuple[int, ...]) -> DataFrame:
    """t0, .. (tile), y0, .. (indices), value: each cell in its own tile and in those whose halo it belongs to. Cells
    away from their tile's border, which are most, make one row without a look at other tiles."""
    df = a.df.select(*a.index_names, "value")
    for d, (n, e, b, size, (low, high)) in enumerate(zip(a.index_names, a.pattern.extents, borders, tile, reach)):
        kept = [c for c in df.columns if c != n]
        df = df.selectExpr("*", f"explode({_places(n, e, size, low, high, b == CYCLIC)}) as _p").where("_p is not null")
        df = df.selectExpr(*kept, f"_p.t as t{d}", f"_p.y as y{d}")
    return df


def tiled(a: GridArray, reach: tuple[tuple[int, int], ...], borders: tuple[str, ...], tile: tuple[int, ...] | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """(t0, .., cells, low0, high0, step0, .., dense) and the tiles' sizes: a row for each tile with its cells and halo
    in order of their indices, the bounds of these, by how many places an index moves, and whether no cell is missing."""
    tile = tile or (TILES.get(a.ndim, 8),) * a.ndim
    dims = range(a.ndim)
    places = ", ".join(f"'y{d}', y{d}" for d in dims)
    df = dealt(a, reach, borders, tile).groupBy(*(f"t{d}" for d in dims)).agg(F.expr(f"sort_array(collect_list(named_struct({places}, 'value', value))) as cells"))
    bounds, widths = [], []
    for d, (e, b, size, (low, high)) in enumerate(zip(a.pattern.extents, borders, tile, reach)):
        begin, end = f"t{d} * {size} + {low}", f"least(t{d} * {size} + {size}, {e}L) + {high}"
        begin, end = (begin, end) if b == CYCLIC else (f"greatest({begin}, 0L)", f"least({end}, {e}L)")
        bounds += [f"{begin} as low{d}", f"{end} as high{d}"]
        widths.append(f"(high{d} - low{d})")
    df = df.selectExpr("*", *bounds)
    steps = [f"{' * '.join(['1L', *widths[d + 1 :]])} as step{d}" for d in dims]
    return df.selectExpr("*", *steps, f"size(cells) = {' * '.join(widths)} as dense"), tile


def _near(offset: tuple[int, ...]) -> str:
    """The value at an offset from cell c, at place i of its tile; null outside. Tiles with holes are searched."""
    moved = [(d, o) for d, o in enumerate(offset) if o]
    inside = " and ".join(f"c.y{d} + {o} >= low{d}" if o < 0 else f"c.y{d} + {o} < high{d}" for d, o in moved) or "true"
    jump = " + ".join(["i", *(f"step{d} * {o}" for d, o in moved)])
    there = " and ".join(f"z.y{d} = c.y{d} + {o}" for d, o in enumerate(offset))
    return f"if({inside}, if(dense, get(cells, cast({jump} as int)).value, get(filter(cells, z -> {there}), 0).value), null)"


def _home(tile: tuple[int, ...], extents: tuple[int, ...]) -> str:
    """Whether cell c is one of the tile's own."""
    return " and ".join(f"c.y{d} >= t{d} * {size} and c.y{d} < least(t{d} * {size} + {size}, {e}L)" for d, (size, e) in enumerate(zip(tile, extents)))


def neighbours(a: GridArray, spec: StencilSpec, borders: tuple[str, ...], outside: Callable[[list[Column]], Column] | None = None, tile: tuple[int, ...] | None = None) -> DataFrame:
    """The indices, value and n0, n1, ...: the neighbours' values; beyond CUSTOM borders those of ``outside`` (a
    function of the coordinates), null beyond NONE borders."""
    names, extents = a.index_names, a.pattern.extents
    df, tile = tiled(a, spec.total(), borders, tile)
    fields = [*(f"'{n}', c.y{d}" for d, n in enumerate(names)), "'value', c.value", *(f"'n{k}', {_near(p.offset)}" for k, p in enumerate(spec.points))]
    cell = f"if({_home(tile, extents)}, named_struct({', '.join(fields)}), null)"
    out = df.selectExpr(f"inline(filter(transform(cells, (c, i) -> {cell}), c -> c is not null))")
    if CUSTOM not in borders or outside is None:
        return out
    filled = []
    for k, p in enumerate(spec.points):
        beyond = lambda kind: [f"({n} + {o} < 0 or {n} + {o} >= {e})" for n, o, e, b in zip(names, p.offset, extents, borders) if b == kind and o]  # noqa: B023, E731
        if not (custom := beyond(CUSTOM)):
            filled.append(F.col(f"n{k}"))
            continue
        there = F.expr(f"({' or '.join(custom)}) and not ({' or '.join(beyond(NONE)) or 'false'})")
        at = [F.expr(f"pmod({n} + {o}, {e}L)" if b == CYCLIC else f"{n} + {o}") for n, o, e, b in zip(names, p.offset, extents, borders)]
        filled.append(F.when(there, outside(at)).otherwise(F.col(f"n{k}")).alias(f"n{k}"))
    return out.select(*names, "value", *filled)


def folded(a: GridArray, spec: StencilSpec, borders: tuple[str, ...], op: ReduceOp = PLUS, centre: float = 1.0, outside: Callable[[list[Column]], Column] | None = None) -> GridArray:
    """The own value times ``centre`` combined by ``op`` with the weighted neighbours; cells without all of them go."""
    df = neighbours(a, spec, borders, outside)
    out, whole = F.col("value") * F.lit(centre), F.col("value").isNotNull()
    for k, p in enumerate(spec.points):
        out, whole = op.two(out, F.col(f"n{k}") * F.lit(float(p.weight))), whole & F.col(f"n{k}").isNotNull()
    return a.with_df(df.where(whole).select(*a.index_names, out.alias("value")))


def apply(a: GridArray, spec: StencilSpec, borders: tuple[str, ...], centre: float = 1.0, outside: Callable[[list[Column]], Column] | None = None) -> GridArray:
    """centre * own value + the weighted sum of the neighbours' values; cells next to a NONE border go."""
    return folded(a, spec, borders, PLUS, centre, outside)


def mapped(a: GridArray, spec: StencilSpec, borders: tuple[str, ...], f: Callable[[Column, list[Column]], Column], outside: Callable[[list[Column]], Column] | None = None) -> GridArray:
    """f(own value, neighbours' values) for all cells; neighbours that are missing are null."""
    df = neighbours(a, spec, borders, outside)
    return a.with_df(df.select(*a.index_names, f(F.col("value"), [F.col(f"n{k}") for k in range(len(spec.points))]).alias("value")))


def sweeps(a: GridArray, spec: StencilSpec, steps: int, centre: float, tile: tuple[int, ...] | None = None) -> GridArray:
    """``steps`` times the weighted sum on a torus, after one shuffle: the halo is as wide as all steps reach, and the
    cells of it that a step can't know are null from there on."""
    names, extents = a.index_names, a.pattern.extents
    reach = tuple((low * steps, high * steps) for low, high in spec.total())
    df, tile = tiled(a, reach, (CYCLIC,) * a.ndim, tile)
    total = " + ".join([f"c.value * {float(centre)!r}D", *(f"{_near(p.offset)} * {float(p.weight)!r}D" for p in spec.points)])
    moved = f"transform(cells, (c, i) -> named_struct({', '.join(f"'y{d}', c.y{d}" for d in range(a.ndim))}, 'value', {total}))"
    for _ in range(steps):
        df = df.withColumn("cells", F.expr(moved))
    own = df.selectExpr(f"inline(filter(cells, c -> {_home(tile, extents)}))")
    return a.with_df(own.selectExpr(*(f"y{d} as {n}" for d, n in enumerate(names)), "value"))


def scattered(a: GridArray, spec: StencilSpec, borders: tuple[str, ...], value: Column, centre: float = 1.0, op: ReduceOp | None = PLUS) -> GridArray:
    """What cells hold after each has sent its ``value`` times the weights to its neighbours, and times ``centre`` to
    itself: what arrives, its own first and the others in order of the stencil, combined by ``op``. Without ``op`` the
    last that arrives replaces the others. What leaves the grid is lost."""
    back = StencilSpec(tuple(Point(tuple(-o for o in p.offset), p.weight) for p in spec.points))
    df = neighbours(a.with_df(a.df.withColumn("value", value)), back, borders)
    out = F.col("value") * F.lit(float(centre))
    for k, p in enumerate(spec.points):
        arrived = F.col(f"n{k}") * F.lit(float(p.weight))
        out = F.coalesce(arrived, out) if op is None else F.coalesce(op.two(out, arrived), out, arrived)
    return a.with_df(df.select(*a.index_names, out.alias("value")))


def scope(a: GridArray, spec: StencilSpec) -> DataFrame:
    """The cells with ``inner``: whether all their neighbours belong to the same unit."""
    own, same = a.pattern.unit_at(a.coords), F.lit(True)
    for p in spec.points:
        at = [c + long(o) for c, o in zip(a.coords, p.offset)]
        inside = F.lit(True)
        for x, e in zip(at, a.pattern.extents):
            inside = inside & (x >= 0) & (x < e)
        same = same & inside & (a.pattern.unit_at(at) == own)
    return a.df.withColumn("inner", same)


def shifted(a: GridArray, offsets: tuple[int, ...], block: int = 1 << 18) -> DataFrame:
    """gidx, value, s0, s1, ...: the values at gidx + offset of a one-dimensional array, null outside.

    Windows run within blocks of the index; cells near a block's end are copied to the neighbouring block, so that
    no task holds more than a block."""
    reach = max(abs(o) for o in offsets)
    g = F.col("gidx")
    homes = F.array_distinct(F.array(div(F.greatest(g - reach, long(0)), block), div(g, block), div(g + reach, block)))
    dealt = a.df.select("gidx", "value", F.explode(homes).alias("_b"))
    w = Window.partitionBy("_b").orderBy("gidx")
    moved = [(F.lead("value", o) if o > 0 else F.lag("value", -o)).over(w).alias(f"s{k}") for k, o in enumerate(offsets)]
    return dealt.select("gidx", "value", "_b", *moved).where(div(g, block) == F.col("_b")).drop("_b")


def jacobi_1d(a: GridArray, steps: int, weights: tuple[float, float, float] = (0.25, 0.5, 0.25), every: int = 8) -> GridArray:
    """Sweeps of a three-point stencil; the two end cells keep their values. Written out every few sweeps."""
    last = a.size - 1
    for step in range(1, steps + 1):
        n = shifted(a, (-1, 1))
        mean = F.lit(weights[0]) * F.col("s0") + F.lit(weights[1]) * F.col("value") + F.lit(weights[2]) * F.col("s1")
        df = n.select("gidx", F.when((F.col("gidx") == 0) | (F.col("gidx") == last), F.col("value")).otherwise(mean).alias("value"))
        a = a.with_df(checkpointed(df) if step % every == 0 and step < steps else df)
    return a


def heat(a: GridArray, steps: int, k: float = 1.0, dt: float = 0.1, dx: float = 1.0, dy: float = 1.0, every: int = 4) -> GridArray:
    """Explicit steps of the heat equation on a torus; ``every`` steps share a shuffle and are written out."""
    x, y = k * dt / dx**2, k * dt / dy**2
    spec = StencilSpec((Point((-1, 0), x), Point((1, 0), x), Point((0, -1), y), Point((0, 1), y)))
    while steps > 0:
        a = sweeps(a, spec, min(every, steps), 1 - 2 * x - 2 * y)
        steps -= every
        a = a.with_df(checkpointed(a.df)) if steps > 0 else a
    return a


def blur(a: GridArray, centre: float = 0.40, side: float = 0.15) -> GridArray:
    """A weighted mean of a cell and its four neighbours; cells at the border keep their values."""
    spec = StencilSpec(tuple(Point(o, side) for o in ((-1, 0), (1, 0), (0, -1), (0, 1))))

    def mean(own: Column, others: list[Column]) -> Column:
        total = own * F.lit(centre)
        for other in others:
            total = total + other * F.lit(side)
        return F.coalesce(total, own)

    return mapped(a, spec, (NONE, NONE), mean)
