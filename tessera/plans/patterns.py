"""Patterns: pure functions from a place in an index space to a unit, a block and a place within the unit.

Every answer is a Column expression of the coordinates, so Catalyst folds it into the scan, or an int where it only
depends on the pattern. Division is integral throughout: doubles would lose indices above 2**53.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.teams import TeamSpec, balance_extents, div_ceil


def long(n: int) -> Column:
    return F.lit(int(n)).cast("long")


def div(a: Column, b: int | Column) -> Column:
    """Integral quotient; for the non-negative indices used here the same as rounding down."""
    return F.call_function("div", a, long(b) if isinstance(b, int) else b)


def mod(a: Column, b: int | Column) -> Column:
    return F.pmod(a, long(b) if isinstance(b, int) else b)


def linear(coords: list[Column], extents: list[int | Column], order: str = "row") -> Column:
    """Place in the order of rows (last coordinate fastest) or of columns."""
    pairs = list(zip(coords, extents))
    if order == "col":
        pairs.reverse()
    out = pairs[0][0]
    for c, e in pairs[1:]:
        out = out * (long(e) if isinstance(e, int) else e) + c
    return out


def coords_of(place: Column, extents: tuple[int, ...], order: str = "row") -> list[Column]:
    """The coordinates of a linear place."""
    out: list[Column] = []
    sizes = list(extents) if order == "row" else list(reversed(extents))
    rest = place
    for e in reversed(sizes[1:]):
        out.append(mod(rest, e))
        rest = div(rest, e)
    out.append(rest)
    return list(reversed(out)) if order == "row" else out


@dataclass(frozen=True)
class Distribution:
    """How one dimension is cut: NONE, BLOCKED, CYCLIC, BLOCKCYCLIC or TILE with a block size."""

    kind: str
    size: int = 0

    def block(self, extent: int, units: int) -> int:
        if self.kind == "NONE":
            return max(1, extent)
        if self.kind == "BLOCKED":
            return max(1, div_ceil(extent, units))
        if self.kind == "CYCLIC":
            return 1
        if self.kind in ("BLOCKCYCLIC", "TILE"):
            return self.size
        raise ValueError(f"unknown distribution {self.kind}")


NONE, BLOCKED, CYCLIC = Distribution("NONE"), Distribution("BLOCKED"), Distribution("CYCLIC")


def BLOCKCYCLIC(size: int) -> Distribution:  # noqa: N802
    return Distribution("BLOCKCYCLIC", size)


def TILE(size: int) -> Distribution:  # noqa: N802
    return Distribution("TILE", size)


def _team(dists: tuple[Distribution, ...], units: int) -> tuple[int, ...]:
    """The grid of units: all in the one dimension that is cut, or balanced over those that are."""
    cut = [d for d, dist in enumerate(dists) if dist.kind != "NONE"]
    out = [1] * len(dists)
    for d, e in zip(cut, balance_extents((units,) + (1,) * (len(cut) - 1)) if cut else ()):
        out[d] = e
    return tuple(out)


@dataclass(frozen=True)
class Pattern:
    """Block pattern: block b of a dimension belongs to unit b mod t of the team grid's dimension.

    Local places run over the unit's own rectangle."""

    extents: tuple[int, ...]
    dists: tuple[Distribution, ...]
    team: TeamSpec
    order: str = "row"

    @classmethod
    def of(cls, extents, dists=None, units: int = 1, team: tuple[int, ...] | None = None, order: str = "row") -> Pattern:
        extents = tuple(extents)
        dists = tuple(dists) if dists else (BLOCKED,) + (NONE,) * (len(extents) - 1)
        return cls(extents, dists, TeamSpec(team or _team(dists, units)), order)

    @property
    def size(self) -> int:
        return math.prod(self.extents)

    @property
    def units(self) -> int:
        return self.team.size

    @property
    def block_sizes(self) -> tuple[int, ...]:
        return tuple(dist.block(e, t) for dist, e, t in zip(self.dists, self.extents, self.team.extents))

    @property
    def block_counts(self) -> tuple[int, ...]:
        return tuple(div_ceil(e, b) for e, b in zip(self.extents, self.block_sizes))

    def coords(self, gidx: Column) -> list[Column]:
        return coords_of(gidx, self.extents, self.order)

    def linear(self, coords: list[Column]) -> Column:
        return linear(coords, list(self.extents), self.order)

    def block_coords(self, coords: list[Column]) -> list[Column]:
        return [div(c, b) for c, b in zip(coords, self.block_sizes)]

    def block_at(self, coords: list[Column]) -> Column:
        """The block's number in row order."""
        return linear(self.block_coords(coords), list(self.block_counts))

    def block_bounds(self, number: int) -> list[tuple[int, int]]:
        """For each dimension the first place of a block and the one behind its last."""
        at = []
        for n in reversed(self.block_counts[1:]):
            at.append(number % n)
            number //= n
        return [(b * i, b * (i + 1)) for b, i in zip(self.block_sizes, (number, *reversed(at)))]

    def unit_coords(self, coords: list[Column]) -> list[Column]:
        return [mod(b, t) for b, t in zip(self.block_coords(coords), self.team.extents)]

    def unit_at(self, coords: list[Column]) -> Column:
        return linear(self.unit_coords(coords), list(self.team.extents)).cast("int")

    def local_coords(self, coords: list[Column]) -> list[Column]:
        """Coordinates within the unit's own blocks laid side by side."""
        return [div(c, b * t) * long(b) + mod(c, b) for c, b, t in zip(coords, self.block_sizes, self.team.extents)]

    def _local_extent(self, d: int, unit: Column) -> Column:
        e, b, t = self.extents[d], self.block_sizes[d], self.team.extents[d]
        return long(e // (b * t) * b) + F.greatest(long(0), F.least(long(b), long(e % (b * t)) - unit * long(b)))

    def local_index(self, coords: list[Column]) -> Column:
        units = self.unit_coords(coords)
        return linear(self.local_coords(coords), [self._local_extent(d, u) for d, u in enumerate(units)], self.order)

    def global_coords(self, unit: int, local: list[Column]) -> list[Column]:
        """The inverse of ``local_coords`` for one unit."""
        at = self.team.coords(unit)
        return [div(x, b) * long(b * t) + long(u * b) + mod(x, b) for x, b, t, u in zip(local, self.block_sizes, self.team.extents, at)]

    def local_extents(self, unit: int) -> tuple[int, ...]:
        out = []
        for e, b, t, u in zip(self.extents, self.block_sizes, self.team.extents, self.team.coords(unit)):
            out.append(e // (b * t) * b + max(0, min(b, e % (b * t) - u * b)))
        return tuple(out)

    def local_size(self, unit: int) -> int:
        return math.prod(self.local_extents(unit))

    def is_local(self, coords: list[Column], unit: int) -> Column:
        return self.unit_at(coords) == F.lit(unit)

    def properties(self) -> frozenset[str]:
        """What holds of the pattern: how it parts, maps and lays out."""
        out = {"rectangular", "canonical" if len(self.extents) == 1 or type(self) is Pattern else "blocked"}
        if all(n % t == 0 for n, t in zip(self.block_counts, self.team.extents)):
            out.add("balanced")
        if all(n <= t for n, t in zip(self.block_counts, self.team.extents)):
            out.add("unimapped")
        if all(e % b == 0 for e, b in zip(self.extents, self.block_sizes)):
            out.add("regular")
        if sum(t > 1 for t in self.team.extents) == len(self.extents):
            out.add("remote-neighbors")
        return frozenset(out)

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, "extents": self.extents, "dists": [[d.kind, d.size] for d in self.dists], "team": self.team.extents, "order": self.order})


@dataclass(frozen=True)
class TilePattern(Pattern):
    """Units as in a block pattern; each tile's elements lie together."""

    def local_index(self, coords: list[Column]) -> Column:
        counts = [div_ceil(n, t) for n, t in zip(self.block_counts, self.team.extents)]
        tiles = linear([div(b, t) for b, t in zip(self.block_coords(coords), self.team.extents)], counts)
        return tiles * long(math.prod(self.block_sizes)) + linear([mod(c, b) for c, b in zip(coords, self.block_sizes)], list(self.block_sizes), self.order)


@dataclass(frozen=True)
class SeqTilePattern(TilePattern):
    """Tiles are dealt in their linear order: the unit is a weighted sum of the tile's coordinates modulo the number of
    units, and a unit's tiles lie in linear order."""

    @property
    def steps(self) -> tuple[int, ...]:
        """By how many units the owner moves on with each coordinate of a tile."""
        out = [1]
        for n in reversed(self.block_counts[1:]):
            out.append(out[-1] * n)
        return tuple(reversed(out))

    def unit_at(self, coords: list[Column]) -> Column:
        total = long(0)
        for b, step in zip(self.block_coords(coords), self.steps):
            total = total + b * step
        return mod(total, self.units).cast("int")

    def _dealt(self, weights: list[list[int]]) -> list[list[int]]:
        """For each dimension d and past the last one: by remainder r, the sum over tiles of the dimensions from d on,
        each coordinate weighted, whose owners are r units before unit 0."""
        u = self.units
        out = [[int(r == 0) for r in range(u)]]
        for own, step in zip(reversed(weights), reversed(self.steps)):
            moved: dict[int, int] = {}  # weight by how far the coordinate moves the owner
            for j, w in enumerate(own):
                moved[j * step % u] = moved.get(j * step % u, 0) + w
            out.append([sum(w * out[-1][(r + m) % u] for m, w in moved.items()) for r in range(u)])
        return out[::-1]

    def local_index(self, coords: list[Column]) -> Column:
        """Behind all tiles of the unit that come before the cell's: those are counted dimension by dimension, from the
        tiles of one period of owners."""
        u = self.units
        counts = self._dealt([[1] * n for n in self.block_counts])
        owner, before, gone = self.unit_at(coords).cast("long"), long(0), long(0)
        for b, n, step, per in zip(self.block_coords(coords), self.block_counts, self.steps, counts[1:]):
            # sums[r][m]: tiles behind the first m coordinates of this dimension, from remainder r on, for one period
            period = min(u, n)
            start = mod(gone - owner, u)
            table = [sum(per[(r + j * step) % u] for j in range(m)) for r in range(u) for m in range(period + 1)]
            whole = [sum(per[(r + j * step) % u] for j in range(u)) for r in range(u)] if n > u else [0] * u
            sums, wholes = F.array(*map(long, table)), F.array(*map(long, whole))
            before = before + div(b, u) * F.get(wholes, start.cast("int")) + F.get(sums, (start * (period + 1) + mod(b, u)).cast("int"))
            gone = gone + b * step
        phase = linear([mod(c, b) for c, b in zip(coords, self.block_sizes)], list(self.block_sizes), self.order)
        return before * long(math.prod(self.block_sizes)) + phase

    def local_size(self, unit: int) -> int:
        """The unit's cells; tiles at the far ends may be smaller."""
        sides = [[min(b, e - j * b) for j in range(n)] for e, b, n in zip(self.extents, self.block_sizes, self.block_counts)]
        return self._dealt(sides)[0][-unit % self.units]


@dataclass(frozen=True)
class ShiftTilePattern(SeqTilePattern):
    """Tiles are dealt along diagonals: the unit is the sum of the tile's coordinates, modulo the number of units."""

    @property
    def steps(self) -> tuple[int, ...]:
        return (1,) * len(self.extents)


@dataclass(frozen=True)
class IrregularPattern:
    """One dimension in contiguous parts of given sizes, one for each unit."""

    sizes: tuple[int, ...]
    order: str = field(default="row", init=False)

    @classmethod
    def balanced(cls, extent: int, weights: list[float]) -> IrregularPattern:
        """Parts in proportion to weights of mean one: rounded up above one, else down; the largest part takes the rest."""
        n, scale = len(weights), sum(weights) / len(weights)
        each = [w / scale for w in weights]
        sizes = [math.ceil(w * extent / n) if w > 1 else math.floor(w * extent / n) for w in each]
        sizes[max(range(n), key=lambda i: sizes[i])] += extent - sum(sizes)
        return cls(tuple(sizes))

    @property
    def extents(self) -> tuple[int, ...]:
        return (sum(self.sizes),)

    @property
    def size(self) -> int:
        return sum(self.sizes)

    @property
    def units(self) -> int:
        return len(self.sizes)

    @property
    def starts(self) -> tuple[int, ...]:
        out, at = [], 0
        for s in self.sizes:
            out.append(at)
            at += s
        return tuple(out)

    def coords(self, gidx: Column) -> list[Column]:
        return [gidx]

    def linear(self, coords: list[Column]) -> Column:
        return coords[0]

    def unit_at(self, coords: list[Column]) -> Column:
        """How many parts end at or before the place; the search is over a literal array, not a join."""
        ends = F.array(*(long(a + s) for a, s in zip(self.starts, self.sizes)))
        return F.size(F.filter(ends, lambda e: e <= coords[0])).cast("int")

    block_at = unit_at

    def block_bounds(self, number: int) -> list[tuple[int, int]]:
        return [(self.starts[number], self.starts[number] + self.sizes[number]) if 0 <= number < self.units else (0, 0)]

    def local_index(self, coords: list[Column]) -> Column:
        return coords[0] - F.element_at(F.array(*map(long, self.starts)), self.unit_at(coords) + 1)

    def local_size(self, unit: int) -> int:
        return self.sizes[unit]

    def is_local(self, coords: list[Column], unit: int) -> Column:
        return (coords[0] >= self.starts[unit]) & (coords[0] < self.starts[unit] + self.sizes[unit])

    def properties(self) -> frozenset[str]:
        return frozenset({"canonical", "unimapped"} | ({"balanced"} if len({*self.sizes}) == 1 else set()))

    def to_json(self) -> str:
        return json.dumps({"kind": "IrregularPattern", "sizes": self.sizes})


def from_json(text: str) -> Pattern | IrregularPattern:
    """A pattern as it was stored."""
    spec = json.loads(text)
    if spec["kind"] == "IrregularPattern":
        return IrregularPattern(tuple(spec["sizes"]))
    kind = {c.__name__: c for c in (Pattern, TilePattern, SeqTilePattern, ShiftTilePattern)}[spec["kind"]]
    return kind(tuple(spec["extents"]), tuple(Distribution(k, s) for k, s in spec["dists"]), TeamSpec(tuple(spec["team"])), spec["order"])


def iterate(spark: SparkSession, pattern: Pattern | IrregularPattern) -> DataFrame:
    """gidx, i0, .., unit, block, lidx: all places of a pattern."""
    places = spark.range(pattern.size).withColumnRenamed("id", "gidx")
    at = pattern.coords(F.col("gidx"))
    named = [c.alias(f"i{d}") for d, c in enumerate(at)]
    return places.select("gidx", *named, pattern.unit_at(at).alias("unit"), pattern.block_at(at).cast("long").alias("block"), pattern.local_index(at).cast("long").alias("lidx"))


def unit_map(spark: SparkSession, pattern: Pattern) -> DataFrame:
    """line, text: for each row of a pattern of two dimensions the units of its cells, parted by blanks."""
    cells = iterate(spark, pattern).groupBy("i0").agg(F.array_sort(F.collect_list(F.struct("i1", "unit"))).alias("row"))
    return cells.select(F.col("i0").alias("line"), F.array_join(F.transform("row", lambda c: c["unit"].cast("string")), " ").alias("text"))


def make_pattern(extents, units: int, wanted: set[str] = frozenset(), tile: tuple[int, ...] | None = None):
    """A pattern with the wanted properties: tiles where elements of a block shall lie together or neighbours shall
    be on other units, else contiguous blocks of the first dimension."""
    extents = tuple(extents)
    if "remote-neighbors" in wanted and len(extents) > 1:
        tile = tile or tuple(max(1, e // units) for e in extents)
        return ShiftTilePattern.of(extents, [TILE(t) for t in tile], team=(units,) + (1,) * (len(extents) - 1))
    if "blocked" in wanted or tile:
        team = balance_extents((units,) + (1,) * (len(extents) - 1))
        tile = tile or tuple(div_ceil(e, t) for e, t in zip(extents, team))
        return TilePattern.of(extents, [TILE(t) for t in tile], team=team)
    return Pattern.of(extents, units=units)
