"""Queries of grids: halos, stencils in two and three dimensions, sweeps, tile patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import GRID, events, grid, query
from tessera.operators import algorithms as alg
from tessera.operators import stencil
from tessera.operators.array import GridArray
from tessera.operators.halo import Halo
from tessera.operators.reduce_ops import MAX, PLUS
from tessera.operators.stencil import CUSTOM, CYCLIC, Point, StencilSpec
from tessera.operators.stencil import NONE as NO_BORDER
from tessera.plans.patterns import BLOCKED, NONE, TILE, Pattern, SeqTilePattern, ShiftTilePattern, TilePattern, long

STAR = StencilSpec((Point((-1, 0), 0.5), Point((1, 0), 0.25), Point((0, -1), 2.0), Point((0, 1), 1.0)))
WIDE = StencilSpec((Point((-2, 0)), Point((0, 1))))


def blocked(spark, d) -> GridArray:
    """The grid over 2 x 4 units, a block for each."""
    g = grid(spark, d)
    return GridArray(g.df, Pattern.of(g.pattern.extents, (BLOCKED, BLOCKED), team=(2, 4)))


def halo(spark, d, borders=(NO_BORDER, CYCLIC), outside=None) -> Halo:
    return Halo(blocked(spark, d), (STAR, WIDE), borders, outside)


#: Blocks (t0, t1) with their first and last (exclusive) cells; the stencils read 2 before and 1 behind in the first
#: dimension, 1 on both sides in the second.
_BLOCKS = """n AS (SELECT max(i0) + 1 AS n FROM g), b AS (SELECT t0, t1, t0 * ((n + 1) // 2) AS a0, least(n, (t0 + 1) * ((n + 1) // 2)) AS z0, t1 * 16 AS a1, t1 * 16 + 16 AS z1, n FROM range(2) x(t0), range(4) y(t1), n)"""
_SIDES = "(CASE WHEN y0 < a0 THEN 0 WHEN y0 >= z0 THEN 2 ELSE 1 END * 3 + CASE WHEN y1 < a1 THEN 0 WHEN y1 >= z1 THEN 2 ELSE 1 END)::INTEGER"
_HALO = f"""WITH {GRID}, {_BLOCKS}, c AS (SELECT i0 AS y0, i1 + s AS y1, value FROM g, (VALUES (-64), (0), (64)) v(s) WHERE i1 + s >= -1 AND i1 + s < 65),
       h AS (SELECT (t0 * 4 + t1)::INTEGER AS unit, t0 * 4 + t1 AS block, {_SIDES} AS region, y0, y1, value FROM b JOIN c ON y0 >= a0 - 2 AND y0 < z0 + 1 AND y1 >= a1 - 1 AND y1 < z1 + 1)"""


@query(f"{_HALO} SELECT * FROM h WHERE region <> 4")
def halo_update(spark, d):
    return halo(spark, d).update()


@query(f"{_HALO} SELECT * FROM h WHERE region = 5")
def halo_update_at(spark, d):
    return halo(spark, d).update_at(5)


@query(f"{_HALO} SELECT value FROM h WHERE block = 3 AND y0 = 1 AND y1 = 64")
def halo_element(spark, d):
    return halo(spark, d).element(3, 1, 64)


@query(f"""WITH {GRID}, {_BLOCKS}, c AS (SELECT y0, y1 FROM (SELECT unnest(range(-2, n + 1)) AS y0 FROM n), range(-1, 65) y(y1)),
       h AS (SELECT (t0 * 4 + t1)::INTEGER AS unit, t0 * 4 + t1 AS block, {_SIDES} AS region, y0, y1 FROM b JOIN c ON y0 >= a0 - 2 AND y0 < z0 + 1 AND y1 >= a1 - 1 AND y1 < z1 + 1)
       SELECT unit, block, region, h.y0, h.y1, coalesce(g.value, h.y0 + h.y1 * 0.5)::DOUBLE AS value FROM h LEFT JOIN g ON i0 = h.y0 AND i1 = h.y1 WHERE region <> 4""")
def halo_custom(spark, d):
    """Halo values beyond the grid from a function of the coordinates there, which may be below zero."""
    return halo(spark, d, (CUSTOM, CUSTOM), lambda c: c[0] + c[1] * 0.5).update()


@query(f"""WITH {GRID}, {_BLOCKS}, s AS (SELECT *, CASE r0 WHEN 0 THEN least(2, a0) WHEN 1 THEN z0 - a0 ELSE least(1, n - z0) END AS w0, CASE r1 WHEN 1 THEN 16 ELSE 1 END AS w1 FROM b, range(3) x(r0), range(3) y(r1))
       SELECT (t0 * 4 + t1)::INTEGER AS unit, t0 * 4 + t1 AS block, (r0 * 3 + r1)::INTEGER AS region, w0 * w1 AS cells FROM s WHERE w0 * w1 > 0""")
def halo_regions(spark, d):
    return halo(spark, d).regions()


@query(f"""WITH {GRID}, {_BLOCKS} SELECT (t0 * 4 + t1)::INTEGER AS unit, t0 * 4 + t1 AS block, (z0 - a0 - 3) * 14 AS inner, (z0 - a0) * 16 - (z0 - a0 - 3) * 14 AS boundary FROM b""")
def halo_boundary_size(spark, d):
    return halo(spark, d).boundary()


@query(f"""WITH {GRID}, {_BLOCKS} SELECT i0, i1, value, i0 > a0 AND i0 < z0 - 1 AND i1 > a1 AND i1 < z1 - 1 AS inner FROM g JOIN b ON i0 >= a0 AND i0 < z0 AND i1 >= a1 AND i1 < z1""")
def stencil_scope(spark, d):
    return stencil.scope(blocked(spark, d), STAR).select("i0", "i1", "value", "inner")


@query(f"""WITH {GRID}, {_BLOCKS}, e AS (SELECT t0 * 4 + t1 AS block, i0, i1, value FROM g JOIN b ON i0 >= a0 AND i0 < z0 AND i1 >= a1 AND i1 < z1 WHERE i1 = z1 - 1)
       SELECT block AS sender, block // 4 * 4 + (block + 1) % 4 AS block, i0 AS y0, value FROM e""")
def halo_swap(spark, d):
    """Each block's last column sent to the block on its right, around the grid."""
    west = Halo(blocked(spark, d), (StencilSpec((Point((0, -1)),)),), (NO_BORDER, CYCLIC)).update_at(3)
    return west.select((F.expr("block div 4") * 4 + F.pmod(F.col("block") + 3, long(4))).alias("sender"), "block", "y0", "value")


# stencils whose results are no plain sums


@query(f"""WITH {GRID}, o AS (SELECT * FROM (VALUES (0, 0, 3.0), (-1, 0, 0.5), (1, 0, 0.25), (0, -1, 2.0), (0, 1, 1.0)) v(a, b, w))
       SELECT g.i0 + a AS i0, (i1 + b + 64) % 64 AS i1, round(sum(value * w), 6) AS value FROM g, o, (SELECT max(i0) AS m FROM g) WHERE g.i0 + a BETWEEN 0 AND m GROUP BY 1, 2""")
def stencil_scatter(spark, d):
    """Values sent to the neighbours and added up there."""
    out = stencil.scattered(grid(spark, d), STAR, (NO_BORDER, CYCLIC), F.col("value"), 3.0)
    return out.df.select("i0", "i1", F.round("value", 6).alias("value"))


@query(f"""WITH {GRID}, o AS (SELECT * FROM (VALUES (0, 0, 0, 3.0), (1, -1, 0, 0.5), (2, 1, 0, 0.25), (3, 0, -1, 2.0), (4, 0, 1, 1.0)) v(k, a, b, w))
       SELECT g.i0 + a AS i0, i1 + b AS i1, arg_max(value * w, k) AS value FROM g, o, (SELECT max(i0) AS m FROM g) WHERE g.i0 + a BETWEEN 0 AND m AND i1 + b BETWEEN 0 AND 63 GROUP BY 1, 2""")
def stencil_scatter_replace(spark, d):
    """The last value that arrives replaces what was there."""
    return stencil.scattered(grid(spark, d), STAR, (NO_BORDER, NO_BORDER), F.col("value"), 3.0, None).df


@query(f"""WITH {GRID} SELECT c.i0, c.i1, round(greatest(c.value, u.value, l.value, w.value, e.value) - least(c.value, u.value, l.value, w.value, e.value), 6) AS value FROM g c
       LEFT JOIN g u ON u.i0 = c.i0 - 1 AND u.i1 = c.i1 LEFT JOIN g l ON l.i0 = c.i0 + 1 AND l.i1 = c.i1 LEFT JOIN g w ON w.i0 = c.i0 AND w.i1 = c.i1 - 1 LEFT JOIN g e ON e.i0 = c.i0 AND e.i1 = c.i1 + 1""")
def stencil_function(spark, d):
    """A function of a cell and the neighbours that it has."""
    out = stencil.mapped(grid(spark, d), STAR, (NO_BORDER, NO_BORDER), lambda v, n: F.greatest(v, *n) - F.least(v, *n))
    return out.df.select("i0", "i1", F.round("value", 6).alias("value"))


@query(f"""WITH {GRID}, o AS (SELECT a - 2 AS a, b - 2 AS b FROM range(5) x(a), range(5) y(b))
       SELECT c.i0, c.i1, max(n.value) AS value FROM g c, o JOIN g n ON n.i0 = c.i0 + a AND n.i1 = c.i1 + b GROUP BY 1, 2 HAVING count(*) = 25""")
def stencil_wide_filter(spark, d):
    """The largest of 25 cells."""
    return stencil.folded(grid(spark, d), StencilSpec.within(2, 2), (NO_BORDER, NO_BORDER), MAX).df.select("i0", "i1", "value")


# three dimensions


_CUBE = f"{GRID}, c AS (SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, value FROM g), n AS (SELECT max(i0) + 1 AS n FROM c), o AS (SELECT a - 1 AS a, b - 1 AS b, e - 1 AS e FROM range(3) x(a), range(3) y(b), range(3) z(e))"


def cube(spark, d) -> GridArray:
    """The grid's rows as planes of 8 x 8."""
    g = grid(spark, d)
    planes = g.df.select("i0", F.expr("i1 div 8").alias("i1"), F.pmod("i1", long(8)).alias("i2"), "value")
    return GridArray(planes, Pattern.of((g.pattern.extents[0], 8, 8)))


def _cube(a: GridArray):
    return a.df.select("i0", "i1", "i2", F.round("value", 6).alias("value"))


@query(f"WITH {_CUBE} SELECT c.i0, c.i1, c.i2, round(sum(x.value), 6) AS value FROM c, o JOIN c x ON x.i0 = c.i0 + a AND x.i1 = c.i1 + b AND x.i2 = c.i2 + e GROUP BY 1, 2, 3 HAVING count(*) = 27")
def stencil_3d_none(spark, d):
    return _cube(stencil.apply(cube(spark, d), StencilSpec.full(3), (NO_BORDER,) * 3))


@query(f"WITH {_CUBE} SELECT c.i0, c.i1, c.i2, round(sum(x.value), 6) AS value FROM c, n, o JOIN c x ON x.i0 = (c.i0 + a + n) % n AND x.i1 = (c.i1 + b + 8) % 8 AND x.i2 = (c.i2 + e + 8) % 8 GROUP BY 1, 2, 3")
def stencil_3d_cyclic(spark, d):
    return _cube(stencil.apply(cube(spark, d), StencilSpec.full(3), (CYCLIC,) * 3))


@query(f"""WITH {_CUBE}, p AS (SELECT c.*, i0 + a AS x0, i1 + b AS x1, i2 + e AS x2 FROM c, o)
       SELECT p.i0, p.i1, p.i2, round(sum(coalesce(x.value, x0 + x1 * 0.5 - x2)), 6) AS value FROM p LEFT JOIN c x ON x.i0 = x0 AND x.i1 = x1 AND x.i2 = x2 GROUP BY 1, 2, 3""")
def stencil_3d_custom(spark, d):
    return _cube(stencil.apply(cube(spark, d), StencilSpec.full(3), (CUSTOM,) * 3, outside=lambda c: c[0] + c[1] * 0.5 - c[2]))


@query(f"""WITH {_CUBE}, p AS (SELECT c.*, i0 + a AS x0, i1 + b AS x1, (i2 + e + 8) % 8 AS x2 FROM c, o)
       SELECT p.i0, p.i1, p.i2, round(sum(coalesce(x.value, x0 + x1 * 0.5 - x2)), 6) AS value FROM p, n LEFT JOIN c x ON x.i0 = x0 AND x.i1 = x1 AND x.i2 = x2 WHERE p.i0 > 0 AND p.i0 < n - 1 GROUP BY 1, 2, 3""")
def stencil_3d_mixed(spark, d):
    """No border in the first dimension, a custom one in the second, a cyclic one in the third."""
    return _cube(stencil.apply(cube(spark, d), StencilSpec.full(3), (NO_BORDER, CUSTOM, CYCLIC), outside=lambda c: c[0] + c[1] * 0.5 - c[2]))


# sweeps


def _sweep(source: str) -> str:
    return f"""SELECT event_id, CASE WHEN event_id = 0 OR event_id = (SELECT max(event_id) FROM events) THEN value
       ELSE 0.25 * lag(value) OVER (ORDER BY event_id) + 0.5 * value + 0.25 * lead(value) OVER (ORDER BY event_id) END AS value FROM {source}"""


_SWEEPS = f"WITH s1 AS ({_sweep('events')}), s2 AS ({_sweep('s1')}), s3 AS ({_sweep('s2')})"


@query(f"{_SWEEPS} SELECT event_id AS gidx, round(value, 8) AS value FROM s3")
def jacobi_sweeps(spark, d):
    return stencil.jacobi_1d(events(spark, d), 3).df.select("gidx", F.round("value", 8).alias("value"))


@query(f"{_SWEEPS} SELECT round(sum((s3.value - s2.value) * (s3.value - s2.value)), 4) AS residual FROM s3 JOIN s2 USING (event_id)")
def jacobi_residual(spark, d):
    """The sum of squares by which the third sweep changes the cells."""
    second = stencil.jacobi_1d(events(spark, d), 2)
    change = alg.transform(stencil.jacobi_1d(second, 1), second, lambda x, y: (x - y) * (x - y))
    return alg.reduce(change, PLUS).select(F.round("value", 4).alias("residual"))


# places within tiles


def _tiles(spark, d, kind, team) -> GridArray:
    g = grid(spark, d)
    return GridArray(g.df, kind.of(g.pattern.extents, (TILE(10), TILE(8)), team=team))


def _places(a: GridArray):
    return a.placed().select("i0", "i1", "unit", F.col("lidx").cast("long").alias("lidx"))


_PHASE = "80 + i0 % 10 * 8 + i1 % 8"
_RANKED = "SELECT i0, i1, {u}::INTEGER AS unit, (dense_rank() OVER (PARTITION BY {u} ORDER BY i0 // 10 * 8 + i1 // 8) - 1) * " + _PHASE + " AS lidx FROM g"


@query(f"WITH {GRID} SELECT i0, i1, (i0 // 10 % 2 * 3 + i1 // 8 % 3)::INTEGER AS unit, (i0 // 20 * 3 + i1 // 24) * {_PHASE} AS lidx FROM g")
def tile_places(spark, d):
    return _places(_tiles(spark, d, TilePattern, (2, 3)))


@query(f"WITH {GRID} {_RANKED.format(u='((i0 // 10 * 8 + i1 // 8) % 5)')}")
def seq_tile_places(spark, d):
    return _places(_tiles(spark, d, SeqTilePattern, (5, 1)))


@query(f"WITH {GRID} {_RANKED.format(u='((i0 // 10 + i1 // 8) % 5)')}")
def shift_tile_places(spark, d):
    """Tiles along diagonals whose number in a row is no multiple of the units."""
    return _places(_tiles(spark, d, ShiftTilePattern, (5, 1)))


@query(f"WITH {GRID} SELECT ((i0 // 10 + i1 // 7) % 5)::INTEGER AS unit, count(*) AS cells, count(*) AS known FROM g GROUP BY 1")
def shift_tile_sizes(spark, d):
    """The units' sizes counted, and as the pattern knows them; the last tile of a row is smaller."""
    g = grid(spark, d)
    p = ShiftTilePattern.of(g.pattern.extents, (TILE(10), TILE(7)), team=(5, 1))
    known = F.array(*(long(p.local_size(u)) for u in range(p.units)))
    return GridArray(g.df, p).placed().groupBy("unit").agg(F.count("*").alias("cells")).select("unit", "cells", F.get(known, "unit").alias("known"))


@query(f"WITH {GRID} SELECT (i1 // 16)::INTEGER AS unit, count(*) AS cells FROM g GROUP BY 1")
def pattern_local_sizes(spark, d):
    """Local sizes of a block pattern from its formula alone."""
    g = grid(spark, d)
    p = Pattern.of(g.pattern.extents, (NONE, BLOCKED), team=(1, 4))
    return spark.createDataFrame([(u, p.local_size(u)) for u in range(p.units)], "unit int, cells long")
