"""Tiled stencils and halos against plain loops; spans of updates; orderings; trees of units; streams."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import algorithms as alg
from tessera.operators import graph, keyed, stencil, views
from tessera.operators.array import GridArray
from tessera.operators.halo import Halo, region_level, region_number, region_offsets
from tessera.operators.reduce_ops import BIT_XOR, MAX, MULTIPLY, PLUS
from tessera.operators.stencil import CUSTOM, CYCLIC, Point, StencilSpec
from tessera.operators.stencil import NONE as NO_BORDER
from tessera.plans.patterns import BLOCKED, CYCLIC as DEALT
from tessera.plans.patterns import TILE, IrregularPattern, Pattern, TilePattern
from tessera.plans.teams import Domain, Team
from tessera.sources import storage
from tessera.streaming import running


def gridded(spark, m, missing=()):
    m = np.asarray(m, float)
    rows = [(*map(int, at), float(m[at])) for at in np.ndindex(m.shape) if at not in missing]
    if m.ndim == 1:
        return GridArray(spark.createDataFrame(rows, "gidx long, value double"), Pattern.of(m.shape))
    return GridArray(spark.createDataFrame(rows, ", ".join(f"i{d} long" for d in range(m.ndim)) + ", value double"), Pattern.of(m.shape))


def neighbour(m, at, borders, outside, missing=()):
    """A value by the rules of borders, None where there is none."""
    kinds = {b for x, e, b in zip(at, m.shape, borders) if not 0 <= x < e}
    wrapped = tuple(x % e if b == CYCLIC else x for x, e, b in zip(at, m.shape, borders))
    if NO_BORDER in kinds:
        return None
    if CUSTOM in kinds:
        return float(outside(wrapped))
    return None if wrapped in missing else m[wrapped]


@pytest.mark.parametrize("tile", [(2, 3), (4, 4), (7, 2), (64, 64)])
@pytest.mark.parametrize("borders", [*itertools.product((NO_BORDER, CYCLIC, CUSTOM), repeat=2)])
def test_neighbours_in_tiles(spark, borders, tile):
    m = np.random.default_rng(1).integers(0, 99, (6, 5)).astype(float)
    spec = StencilSpec(tuple(map(Point, ((-2, 0), (1, 1), (0, -1), (0, 3), (-1, -1)))))
    missing = {(1, 1), (5, 0)} if tile == (4, 4) else ()
    outside = lambda c: c[0] * 100 + c[1]
    rows = stencil.neighbours(gridded(spark, m, missing), spec, borders, outside, tile).collect()
    assert sorted((r.i0, r.i1) for r in rows) == sorted(at for at in np.ndindex(m.shape) if at not in missing)
    for r in rows:
        assert r.value == m[r.i0, r.i1]
        for k, p in enumerate(spec.points):
            at = (r.i0 + p.offset[0], r.i1 + p.offset[1])
            assert r[f"n{k}"] == neighbour(m, at, borders, outside, missing), (at, borders)


@pytest.mark.parametrize("shape,tile", [((11,), (4,)), ((3, 4, 5), (2, 3, 2))])
def test_neighbours_of_other_dimensions(spark, shape, tile):
    m = np.random.default_rng(2).random(shape)
    spec = StencilSpec.full(len(shape))
    for borders in ((NO_BORDER,) * len(shape), (CYCLIC,) * len(shape)):
        for r in stencil.neighbours(gridded(spark, m), spec, borders, tile=tile).collect():
            at = tuple(r[: len(shape)])
            assert [r[f"n{k}"] for k in range(len(spec.points))] == [neighbour(m, tuple(a + o for a, o in zip(at, p.offset)), borders, None) for p in spec.points]


@pytest.mark.parametrize("tile", [(2, 2), (3, 5), (64, 64)])
def test_sweeps_equal_steps(spark, tile):
    m = np.random.default_rng(3).random((7, 5))
    spec = StencilSpec((Point((-1, 0), 0.1), Point((0, 2), 0.3)))
    h = m.copy()
    for _ in range(3):
        h = 0.5 * h + 0.1 * np.roll(h, 1, 0) + 0.3 * np.roll(h, -2, 1)
    got = {(r.i0, r.i1): r.value for r in stencil.sweeps(gridded(spark, m), spec, 3, 0.5, tile).df.collect()}
    assert len(got) == 35 and all(got[at] == pytest.approx(h[at]) for at in np.ndindex(7, 5))


def test_scattering(spark):
    m = np.arange(12.0).reshape(3, 4) + 1
    spec = StencilSpec((Point((0, 1), 10.0), Point((1, 0), 100.0)))
    want = {at: [m[at]] for at in np.ndindex(3, 4)}
    for i, j in np.ndindex(3, 4):
        if j + 1 < 4:
            want[i, j + 1].append(10 * m[i, j])
    for i, j in np.ndindex(3, 4):
        if i + 1 < 3:
            want[i + 1, j].append(100 * m[i, j])
    for op, of in ((PLUS, sum), (MAX, max), (None, lambda v: v[-1])):
        got = {(r.i0, r.i1): r.value for r in stencil.scattered(gridded(spark, m), spec, (NO_BORDER, NO_BORDER), F.col("value"), 1.0, op).df.collect()}
        assert got == {at: of(v) for at, v in want.items()}


def test_regions():
    for n in (1, 2, 3):
        assert [region_number(region_offsets(k, n)) for k in range(3**n)] == list(range(3**n))
        assert region_level(3**n // 2, n) == 0 and region_level(0, n) == n
    assert region_offsets(5, 2) == (0, 1) and region_level(5, 2) == 1


@pytest.mark.parametrize("borders", [(NO_BORDER, CYCLIC), (CYCLIC, CYCLIC), (CUSTOM, NO_BORDER), (CUSTOM, CYCLIC), (NO_BORDER, NO_BORDER)])
@pytest.mark.parametrize("dists,team", [((BLOCKED, BLOCKED), (2, 2)), ((DEALT, BLOCKED), (2, 3))])
def test_halo(spark, borders, dists, team):
    m = np.random.default_rng(4).random((5, 7))
    a = GridArray(gridded(spark, m).df, Pattern.of(m.shape, dists, team=team))
    outside = lambda c: c[0] * 100 + c[1]
    halo = Halo(a, (StencilSpec((Point((-2, 0)), Point((0, 1)))), StencilSpec((Point((1, -1)),))), borders, outside)
    assert halo.reach == ((-2, 1), (-1, 1))
    sizes, counts, want = a.pattern.block_sizes, a.pattern.block_counts, {}
    for t in np.ndindex(counts):
        begin = [x * s for x, s in zip(t, sizes)]
        end = [min(b + s, e) for b, s, e in zip(begin, sizes, m.shape)]
        for y in itertools.product(range(begin[0] - 2, end[0] + 1), range(begin[1] - 1, end[1] + 1)):
            side = tuple(-1 if x < b else int(x >= z) for x, b, z in zip(y, begin, end))
            value = neighbour(m, y, borders, outside)
            if any(side) and value is not None:
                want[t[0] * counts[1] + t[1], *y] = (region_number(side), value)
    got = {(r.block, r.y0, r.y1): (r.region, r.value) for r in halo.update().collect()}
    assert got == want
    n = halo.regions().where("region <> 4").groupBy("block").agg(F.sum("cells").alias("n")).collect()
    assert {r.block: r.n for r in n} == {b: sum(k[0] == b for k in want) for b in {k[0] for k in want}}
    both = halo.boundary().agg(F.sum("inner") + F.sum("boundary")).head()[0]
    assert both == 35 and halo.update_at(1).count() == sum(r == 1 for r, _ in want.values())
    block, y0, y1 = next(iter(want))
    assert halo.element(block, y0, y1).head()[0] == want[block, y0, y1][1]


def test_updates_of_one_cell_over_spans(spark):
    """Sequence numbers far apart and below zero, so that a cell's updates stand in several spans."""
    rng = np.random.default_rng(5)
    seqs = sorted({int(x) for x in rng.integers(-300_000, 300_000, 60)})
    rows = [(g, s, int(rng.integers(1, 9))) for g in (0, 1) for s in seqs]
    u = spark.createDataFrame(rows, "gidx long, seq long, value long")
    for op, of in ((PLUS, sum), (MAX, max), (BIT_XOR, lambda v: int(np.bitwise_xor.reduce(v))), (MULTIPLY, lambda v: float(np.prod(np.array(v, float))))):
        got = {(r.gidx, r.seq): r.fetched for r in keyed.fetch_op(u, op=op).collect()}
        for g in (0, 1):
            mine = [(s, v) for k, s, v in rows if k == g]
            for n, (s, _) in enumerate(mine):
                assert got[g, s] == (pytest.approx(of([v for _, v in mine[:n]]), rel=1e-12) if n else None)
    sub = {(r.gidx, r.seq): (r.value, r.fetched) for r in keyed.fetch_sub(u, spark.createDataFrame([(0, 50)], "gidx long, value long")).collect()}
    assert sub[0, seqs[2]] == (rows[2][2], 50 - rows[0][2] - rows[1][2]) and sub[1, seqs[0]][1] == 0
    listed = keyed.push_back(spark.createDataFrame([(0, 0, 7)], "unit int, lseq long, value long"), u.select(F.col("gidx").cast("int").alias("unit"), "seq", "value"))
    assert [r.value for r in listed.where("unit = 0").orderBy("lseq").collect()] == [7] + [v for g, _, v in rows if g == 0]
    assert [r.lseq for r in listed.where("unit = 1").orderBy("lseq").collect()] == list(range(len(seqs)))


def test_maps_by_range_and_in_place(spark):
    batch = spark.createDataFrame([(1, 10, 0), (2, 20, 1), (1, 11, 2), (3, 30, 3)], "key long, mapped long, seq long")
    first = keyed.insert_range(batch, 0, 2)
    assert sorted(map(tuple, first.collect())) == [(1, 10), (2, 20)]
    assert sorted(map(tuple, keyed.insert_range(batch, 2, 9, first).collect())) == [(1, 10), (2, 20), (3, 30)]
    updates = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (9, 1, 2)], "key long, value long, seq long")
    assert sorted(map(tuple, keyed.update_mapped(first, updates).collect())) == [(1, 21), (2, 20)]
    assert sorted((r.key, r.unit) for r in keyed.bucket(first, 2, whole=True).collect()) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("nodes,edges,most", [(12, 22, 10**6), (5, 6, 3)])
def test_orders_of_tables_and_of_the_driver(spark, nodes, edges, most):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, nodes, (edges, 2))] + [(20, 20)]
    near = {n: set() for e in pairs for n in e}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = []
    while near:
        node = min(near, key=lambda n: (len(near[n]), n))
        want.append((len(want), node, len(near[node])))
        around = near.pop(node)
        for n in around:
            near[n] = (near[n] | around) - {n, node}
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert [tuple(r) for r in graph.minimum_degree_order(df, most=most).orderBy("step").collect()] == want


def test_views_over_views(spark):
    a = GridArray.from_values(spark, list(range(20)), "long")
    b = GridArray.from_values(spark, [100 + i for i in range(20)], "long")
    view = views.strided(views.sub(a, 4, 16), 3, 1)
    assert sorted(r.value for r in views.apply(view, b).df.collect()) == sorted(100 + r.value for r in view.df.collect())
    assert views.combine(views.sub(a, 0, 5), views.sub(a, 3, 6)).count() == 8
    spec = views.ViewSpec.of((6, 8)).slice(0, 1, 4).slice(1, 2, 99).slice(1, 1, 2).resize(0, 2)
    assert (spec.offsets, spec.extents, spec.size) == ((1, 3), (2, 2), 4)


def test_copy_joins_only_what_is_written(spark):
    a = GridArray.from_values(spark, list(range(10)), "long")
    b = GridArray.from_values(spark, [-i for i in range(10)], "long")
    got = [r.value for r in alg.copy(a, b, (2, 6), 5).df.orderBy("gidx").collect()]
    assert got == [0, -1, -2, -3, -4, 2, 3, 4, 5, -9]


def test_values_are_converted_by_size(spark):
    a = GridArray.from_values(spark, [1, 2], "long")
    assert alg.converted(a, "bigint").df.schema["value"].dataType.simpleString() == "bigint"
    for kind in ("int", "double", "float"):
        with pytest.raises(TypeError):
            alg.converted(a, kind)
    assert alg.convertible("int", "integer") and not alg.convertible("float", "double")


def test_domains_and_siblings():
    nodes = tuple(Domain(f"n{i}", "node", (), tuple(Domain(f"n{i}c{j}", "core", (4 * i + j,)) for j in range(4))) for i in range(3))
    world = Domain("world", "global", (), nodes)
    assert world.all_units() == tuple(range(12)) and world.find("n1c2").units == (6,)
    assert world.select({"n0", "n2c1"}).all_units() == (0, 1, 2, 3, 9) and world.exclude({"n0", "n2c1"}).all_units() == (4, 5, 6, 7, 8, 10, 11)
    grouped = world.group({"n0", "n2"}, "pair")
    assert [p.name for p in grouped.parts] == ["pair", "n1"] and grouped.find("pair").all_units() == (0, 1, 2, 3, 8, 9, 10, 11)
    assert [t.members for t in world.split(2, "node")] == [tuple(range(8)), tuple(range(8, 12))] and len(world.scoped("core")) == 12
    with pytest.raises(KeyError):
        world.find("none")
    parts = Team.all(10).split(3)
    assert [t.members for t in parts[1].siblings()] == [t.members for t in parts] and parts[2].sibling(0) == parts[0]
    assert parts[1].split(2)[1].path() == (1, 1) and Team.all(3).siblings() == []


def test_stores_modify_wait_and_remove(spark, tmp_path):
    a = GridArray.from_values(spark, [1.0, 2.0, 3.0], "double", IrregularPattern((1, 2)))
    store = storage.ArrayStore(spark, str(tmp_path)).dataset("a/b").pattern_key("layout").later()
    store << a
    store.modify() << a.with_df(a.df.where("gidx = 1").withColumn("value", F.lit(9.0)))
    assert not list(tmp_path.iterdir())
    store.flush()
    back = store >> None
    assert [r.value for r in back.df.orderBy("gidx").collect()] == [1.0, 9.0, 3.0] and back.pattern == a.pattern
    assert store.remove() and not store.remove()


def parts(folder):
    return list(folder.rglob("*.parquet"))


def test_stored_blocks_share_files(spark, tmp_path, capsys):
    """As many files as tasks, not as blocks; a block is found by its bounds."""
    m = np.arange(40.0 * 30).reshape(40, 30)
    a = GridArray(gridded(spark, m).df, TilePattern.of(m.shape, (TILE(2), TILE(3)), team=(2, 2)))
    store = storage.ArrayStore(spark, str(tmp_path)).by_block()
    store << a
    assert len(parts(tmp_path)) <= 4
    back = store >> None
    assert sorted(map(tuple, back.df.collect())) == sorted(map(tuple, a.df.collect())) and back.pattern == a.pattern
    one = views.block(back, 57)  # row 5, column 7 of the blocks
    assert sorted((r.i0, r.i1, r.value) for r in one.collect()) == [(i, j, m[i, j]) for i in (10, 11) for j in (21, 22, 23)]
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert all(f in plan for f in ("GreaterThanOrEqual(i0,10)", "LessThan(i0,12)", "GreaterThanOrEqual(i1,21)", "LessThan(i1,24)"))
    assert spark.read.parquet(f"{tmp_path}/data/data").where("block = 57").count() == 6


def test_stored_blocks_keep_further_cells(spark, tmp_path):
    """Cells that are appended out of the order of blocks are read too."""
    a = gridded(spark, np.arange(24.0).reshape(4, 6), missing={(1, 1), (3, 5)})
    store = storage.ArrayStore(spark, str(tmp_path))
    store.by_block() << a
    store.mode("append") << a.with_df(spark.createDataFrame([(1, 1, 7.0)], a.df.schema))
    store.by_block().mode("append") << a.with_df(spark.createDataFrame([(3, 5, 23.0)], a.df.schema))
    assert sorted(r.value for r in store.read().df.collect()) == [float(v) for v in range(24)]
    store.by_block().modify() << a.with_df(spark.createDataFrame([(0, 0, -1.0)], a.df.schema))
    assert sorted(r.value for r in store.read().df.collect()) == [-1.0, *(float(v) for v in range(1, 24))]


def test_a_folder_for_each_block_is_read_but_not_appended_to(spark, tmp_path):
    """Arrays stored by earlier versions: appended cells would not be read."""
    a = gridded(spark, np.arange(6.0).reshape(2, 3))
    store = storage.ArrayStore(spark, str(tmp_path))
    a.df.withColumn("block", F.col("i0")).write.partitionBy("block").parquet(f"{tmp_path}/data/data")
    more = a.with_df(spark.createDataFrame([(1, 2, 9.0)], a.df.schema))
    for kind in (store, store.by_block()):
        with pytest.raises(ValueError, match="folder for each block"):
            kind.mode("append") << more
    assert sorted(r.value for r in store.read(a.pattern).df.collect()) == [0, 1, 2, 3, 4, 5]
    store.by_block().modify() << more
    store.mode("append") << a.with_df(spark.createDataFrame([(2, 0, 6.0)], a.df.schema))
    assert sorted(r.value for r in store.read(a.pattern).df.collect()) == [0, 1, 2, 3, 4, 6, 9]


def test_one_stored_block_is_cut(spark, tmp_path):
    """All cells in one block don't go to one task; nor does an array of no cells hinder reading."""
    a = GridArray.allocate(spark, Pattern.of((40_000,)), F.lit(1.0))
    store = storage.ArrayStore(spark, str(tmp_path)).by_block()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.dataset("a") << a
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [spark.read.parquet(str(p)).count() for p in parts(tmp_path)]
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    store.dataset("none") << a.with_df(a.df.limit(0))
    assert (store.dataset("none") >> None).df.count() == 0


def test_adjacency_over_many_lines(spark, tmp_path):
    (tmp_path / "g.adj").write_text("0 2 2 5\n1 2\n0\n\n1 2\n")
    assert sorted(map(tuple, storage.read_adjacency(spark, str(tmp_path / "g.adj")).collect())) == [(0, 1), (0, 2), (2, 0), (2, 1), (2, 2)]
    (tmp_path / "empty.adj").write_text("\n")
    assert storage.read_adjacency(spark, str(tmp_path / "empty.adj")).count() == 0


def test_entry_equal_to_the_size_line(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate integer symmetric\n3 2 1\n3 2 1\n")
    assert sorted(map(tuple, storage.read_matrix_market(spark, str(tmp_path / "g.mtx")).collect())) == [(1, 2), (2, 1)]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", k, float(h * m)) for h in range(6) for m in range(0, 60, 7) for k in ("a", "b")]
    events = spark.createDataFrame(rows, "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    for part in range(3):
        events.where(F.pmod(F.hour("t"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, mode, of in (("windows", "complete", lambda e: running.windowed_reduce(e, "t", "v", "1 hour", "10 hours", "k")), ("counts", "complete", lambda e: running.running_histogram(e, "k"))):
        q = of(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, of(events).collect()))
    late = spark.createDataFrame([("2024-01-02 12:00:00", "a", 1.0)], "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    last = spark.createDataFrame([("2024-01-01 00:30:00", "a", 1.0), ("2024-01-02 12:30:00", "a", 1.0)], "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    found = []
    for df in (late, last):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/more")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/more")
        q = running.windowed_reduce(stream, "t", "v", "1 hour", "1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/late")
        q.foreachBatch(lambda b, _: found.extend(map(tuple, b.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert [(r[1], r[2]) for r in found] == [(1, 1.0), (2, 2.0)]  # the row of the day before came too late
