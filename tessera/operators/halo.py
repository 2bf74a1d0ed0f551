"""The halo of a distributed grid: the cells around each block that its stencils read.

A block's surroundings are parted into 3**n regions by whether a cell lies before, within or behind the block in each
dimension; a region's number has these as its digits (0, 1, 2), the first dimension first, and the one in the middle
is the block itself. Halo cells keep the indices that the block sees: beyond the grid where a border wraps or is custom.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.array import GridArray
from tessera.operators.stencil import CUSTOM, CYCLIC, NONE, StencilSpec, dealt
from tessera.plans.patterns import coords_of, linear, long, mod


def region_number(offsets: tuple[int, ...]) -> int:
    """Of a region that lies at -1, 0 or 1 from the block in each dimension."""
    out = 0
    for o in offsets:
        out = out * 3 + o + 1
    return out


def region_offsets(number: int, ndim: int) -> tuple[int, ...]:
    return tuple(number // 3 ** (ndim - 1 - d) % 3 - 1 for d in range(ndim))


def region_level(number: int, ndim: int) -> int:
    """In how many dimensions a region is beside the block: 1 for faces (edges of two dimensions), ndim for corners."""
    return sum(o != 0 for o in region_offsets(number, ndim))


@dataclass(frozen=True)
class Halo:
    """A grid with the halo that one or more stencils need; ``outside`` gives values beyond CUSTOM borders."""

    array: GridArray
    specs: tuple[StencilSpec, ...]
    borders: tuple[str, ...]
    outside: Callable[[list[Column]], Column] | None = None

    @property
    def reach(self) -> tuple[tuple[int, int], ...]:
        """How far the stencils read in each dimension, as (lowest, highest) offset."""
        each = [s.total() for s in self.specs]
        return tuple((min(t[d][0] for t in each), max(t[d][1] for t in each)) for d in range(self.array.ndim))

    @property
    def blocks(self) -> tuple[int, ...]:
        return self.array.pattern.block_sizes

    def _unit(self) -> Column:
        """The unit of the block t0, t1, ..."""
        team = self.array.pattern.team.extents
        return linear([mod(F.col(f"t{d}"), t) for d, t in enumerate(team)], list(team)).cast("int")

    def _region(self) -> Column:
        out = long(0)
        for d, (size, e) in enumerate(zip(self.blocks, self.array.pattern.extents)):
            y, begin = F.col(f"y{d}"), F.col(f"t{d}") * size
            out = out * 3 + F.when(y < begin, 0).when(y >= F.least(begin + size, long(e)), 2).otherwise(1)
        return out.cast("int")

    def regions(self) -> DataFrame:
        """unit, block, region, cells: the size of each region that has cells, and under the middle region's number
        the number of the block's own cells. From the pattern alone."""
        a, n = self.array, self.array.ndim
        count = 1
        for c in a.pattern.block_counts:
            count *= c
        blocks = a.df.sparkSession.range(count).withColumnRenamed("id", "block")
        blocks = blocks.select("block", *(c.alias(f"t{d}") for d, c in enumerate(coords_of(F.col("block"), a.pattern.block_counts))))
        sizes = []
        for number in range(3**n):
            cells = long(1)
            for d, (o, size, e, (low, high), b) in enumerate(zip(region_offsets(number, n), self.blocks, a.pattern.extents, self.reach, self.borders)):
                begin = F.col(f"t{d}") * size
                end = F.least(begin + size, long(e))
                width = end - begin if o == 0 else long(-low if o < 0 else high)
                if b == NONE and o:  # what is beyond the grid is not there
                    width = F.least(width, begin) if o < 0 else F.least(width, long(e) - end)
                cells = cells * width
            sizes.append(F.struct(F.lit(number).alias("region"), cells.alias("cells")))
        out = blocks.select(self._unit().alias("unit"), "block", F.explode(F.array(*sizes)).alias("r"))
        return out.select("unit", "block", "r.region", "r.cells").where("cells > 0")

    def boundary(self) -> DataFrame:
        """unit, block, inner, boundary: how many of a block's cells read no halo, and how many do."""
        own = self.regions().where(F.col("region") == 3**self.array.ndim // 2)
        at = coords_of(F.col("block"), self.array.pattern.block_counts)
        inner = long(1)
        for t, size, e, (low, high) in zip(at, self.blocks, self.array.pattern.extents, self.reach):
            inner = inner * F.greatest(F.least(t * size + size, long(e)) - t * size + low - high, long(0))
        return own.select("unit", "block", inner.alias("inner"), (F.col("cells") - inner).alias("boundary"))

    def update(self) -> DataFrame:
        """unit, block, region, y0, .., value: the halo of every block. Only cells near a block's border are copied."""
        a, n = self.array, self.array.ndim
        rows = dealt(a, self.reach, self.borders, self.blocks)
        if CUSTOM in self.borders and self.outside is not None:
            rows = rows.unionByName(self._beyond())
        block = linear([F.col(f"t{d}") for d in range(n)], list(a.pattern.block_counts))
        rows = rows.select(self._unit().alias("unit"), block.alias("block"), self._region().alias("region"), *(f"y{d}" for d in range(n)), "value")
        return rows.where(F.col("region") != 3**n // 2)

    def _beyond(self) -> DataFrame:
        """The cells beyond CUSTOM borders, from the sizes of the regions there."""
        a, n = self.array, self.array.ndim
        parts = []
        rows = self.regions().select("region", *(c.alias(f"t{d}") for d, c in enumerate(coords_of(F.col("block"), a.pattern.block_counts))))
        for number in range(3**n):
            part, outside, lost = rows.where(F.col("region") == number), F.lit(False), F.lit(False)
            for d, (o, size, e, (low, high), b) in enumerate(zip(region_offsets(number, n), self.blocks, a.pattern.extents, self.reach, self.borders)):
                begin = F.col(f"t{d}") * size
                end = F.least(begin + size, long(e))
                first, last = (begin + low, begin) if o < 0 else (end, end + high) if o else (begin, end)
                part = part.withColumn(f"y{d}", F.explode(F.sequence(first, last - 1)))
                beyond = (F.col(f"y{d}") < 0) | (F.col(f"y{d}") >= e)
                outside, lost = (outside | beyond if b == CUSTOM else outside), (lost | beyond if b == NONE else lost)
            if number != 3**n // 2:
                parts.append(part.where(outside & ~lost))
        wrapped = [mod(F.col(f"y{d}"), e) if b == CYCLIC else F.col(f"y{d}") for d, (e, b) in enumerate(zip(a.pattern.extents, self.borders))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*(f"t{d}" for d in range(n)), *(f"y{d}" for d in range(n)), self.outside(wrapped).alias("value"))

    def update_at(self, region: int) -> DataFrame:
        """One region of every block's halo."""
        return self.update().where(F.col("region") == region)

    def element(self, block: int, *at: int) -> DataFrame:
        """value of the halo cell of a block at indices as the block sees them; no row where it has none there."""
        rows = self.update().where(F.col("block") == block)
        for d, y in enumerate(at):
            rows = rows.where(F.col(f"y{d}") == y)
        return rows.select("value")
