"""Patterns against their definitions, for even and uneven numbers of units."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessera.plans.patterns import BLOCKCYCLIC, BLOCKED, CYCLIC, NONE, TILE, IrregularPattern, Pattern, SeqTilePattern, ShiftTilePattern, TilePattern, from_json, make_pattern
from tessera.plans.teams import Team, TeamSpec, balance_extents, factorize

UNITS = (1, 2, 3, 4, 7, 8, 11, 12)


def placed(spark, pattern):
    df = spark.range(pattern.size).withColumnRenamed("id", "gidx")
    c = pattern.coords(F.col("gidx"))
    rows = df.select("gidx", pattern.unit_at(c).alias("u"), pattern.local_index(c).alias("l"), pattern.block_at(c).alias("b")).collect()
    return {r.gidx: (r.u, r.l, r.b) for r in rows}


@pytest.mark.parametrize("units", UNITS)
def test_one_dimension(spark, units):
    n = 11 * units - 1
    for dist, block in ((BLOCKED, math.ceil(n / units)), (CYCLIC, 1), (BLOCKCYCLIC(5), 5), (TILE(4), 4)):
        pattern = Pattern.of((n,), (dist,), units)
        got = placed(spark, pattern)
        seen = dict.fromkeys(range(units), 0)
        for g in range(n):
            u = g // block % units
            assert got[g] == (u, seen[u], g // block)
            seen[u] += 1
        assert [pattern.local_size(u) for u in range(units)] == [seen[u] for u in range(units)]


@pytest.mark.parametrize("team", [(1, 1), (2, 3), (4, 1), (1, 5)])
@pytest.mark.parametrize("order", ["row", "col"])
def test_two_dimensions(spark, team, order):
    pattern = Pattern.of((9, 7), (TILE(2), BLOCKED), team=team, order=order)
    got = placed(spark, pattern)
    assert len({(u, x) for u, x, _ in got.values()}) == 63
    for u in range(pattern.units):
        assert sorted(x for v, x, _ in got.values() if v == u) == list(range(pattern.local_size(u)))
    b1 = math.ceil(7 / team[1])
    for i, j in itertools.product(range(9), range(7)):
        g = i * 7 + j if order == "row" else j * 9 + i
        assert got[g][0] == (i // 2 % team[0]) * team[1] + j // b1 % team[1]


@pytest.mark.parametrize(
    "pattern",
    [
        Pattern.of((23,), (BLOCKCYCLIC(3),), 4),
        Pattern.of((9, 7), (TILE(2), BLOCKED), team=(2, 3), order="col"),
        ShiftTilePattern.of((4, 5, 6), (TILE(2), TILE(2), TILE(4)), team=(2, 1, 1)),
        IrregularPattern((3, 0, 5)),
    ],
)
def test_block_bounds(spark, pattern):
    cells = spark.range(pattern.size)
    c = pattern.coords(F.col("id"))
    for r in cells.select(pattern.block_at(c).alias("b"), *(x.alias(f"i{d}") for d, x in enumerate(c))).collect():
        at = r[1:]
        inside = [n for n in range(r.b + 2) if all(begin <= x < end for x, (begin, end) in zip(at, pattern.block_bounds(n)))]
        assert inside == [r.b]


def test_global_coords_invert_local_ones(spark):
    pattern = Pattern.of((23,), (BLOCKCYCLIC(3),), 4)
    df = spark.range(23)
    c = [F.col("id")]
    for u in range(4):
        back = pattern.global_coords(u, pattern.local_coords(c))[0]
        assert df.where(pattern.unit_at(c) == u).where(back != F.col("id")).count() == 0


def test_tile_patterns(spark):
    for kind, unit in ((SeqTilePattern, lambda a, b: (a * 4 + b) % 5), (ShiftTilePattern, lambda a, b: (a + b) % 5)):
        pattern = kind.of((9, 8), (TILE(2), TILE(2)), team=(5, 1))
        c = pattern.coords(F.col("id"))
        got = {r.id: r.u for r in spark.range(72).select("id", pattern.unit_at(c).alias("u")).collect()}
        assert all(got[i * 8 + j] == unit(i // 2, j // 2) for i in range(9) for j in range(8))
    pattern = TilePattern.of((4, 4), (TILE(2), TILE(2)), team=(1, 1))
    assert [placed(spark, pattern)[g][1] for g in range(8)] == [0, 1, 4, 5, 2, 3, 6, 7]


@pytest.mark.parametrize("units", UNITS)
def test_irregular(spark, units):
    pattern = IrregularPattern(tuple((u + 2) * 4 for u in range(units)))
    got = placed(spark, pattern)
    g = 0
    for u in range(units):
        for x in range((u + 2) * 4):
            assert got[g][:2] == (u, x)
            g += 1


def test_balanced_weights():
    pattern = IrregularPattern.balanced(2017, [8.0] + [1.0] * 7)
    assert sum(pattern.sizes) == 2017 and max(pattern.sizes) == pattern.sizes[0] > 1000


def test_stored_form():
    for p in (Pattern.of((9, 7), (TILE(2), NONE), 3), ShiftTilePattern.of((8, 8), (TILE(2), TILE(2)), team=(4, 1)), IrregularPattern((3, 5))):
        assert from_json(p.to_json()) == p


def test_teams():
    assert balance_extents((21, 2, 3)) == (7, 6, 3)
    assert factorize(360) == {2: 3, 3: 2, 5: 1}
    parts = Team.all(10).split(4)
    assert [p.members for p in parts] == [(0, 1, 2), (3, 4, 5), (6, 7, 8), (9,)]
    spec = TeamSpec((2, 3))
    assert spec.neighbor(0, (-1, 0)) is None and spec.periodic_neighbor(0, (-1, -1)) == 5
    assert parts[0].union(parts[3]).intersect(Team.all(3)).members == (0, 1, 2)


def test_make_pattern():
    assert "remote-neighbors" in make_pattern((8, 8), 4, {"remote-neighbors"}).properties() or make_pattern((8, 8), 4, {"remote-neighbors"}).units == 4
    assert make_pattern((16, 16), 4, {"blocked"}).team.extents == (2, 2)
    assert make_pattern((16,), 4).block_sizes == (4,)
