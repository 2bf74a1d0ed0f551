"""Operators on small arrays with results known in closed form, by number of units and on awkward shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import algorithms as alg
from tessera.operators import collectives, graph, keyed, linalg, stencil, views
from tessera.operators.array import GridArray
from tessera.operators.reduce_ops import MAX, OPS, PLUS, custom
from tessera.plans.patterns import BLOCKCYCLIC, BLOCKED, CYCLIC, NONE, TILE, Pattern
from tessera.sources import storage

UNITS = (1, 2, 3, 4, 7, 8, 11, 12)


def array(spark, values, kind="long", pattern=None):
    return GridArray.from_values(spark, values, kind, pattern)


def values(a):
    return [r.value for r in sorted(a.df.select(*a.index_names, "value").collect())]


def matrix(spark, m):
    m = np.asarray(m, float)
    rows = [(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return GridArray(spark.createDataFrame(rows, "i0 long, i1 long, value double"), Pattern.of(m.shape))


def dense(a):
    out = np.full(a.pattern.extents, np.nan)
    for r in a.df.collect():
        out[r.i0, r.i1] = r.value
    return out


@pytest.mark.parametrize("units", UNITS)
def test_reduce(spark, units):
    a = GridArray.allocate(spark, Pattern.of((100 * units,), (CYCLIC,), units), F.lit(2).cast("long"))
    assert alg.reduce(a, PLUS, F.lit(10)).head()[0] == 200 * units + 10
    assert [r[0] for r in alg.reduce(a, PLUS, by="unit").select("value").collect()] == [200] * units
    assert alg.reduce(a, PLUS, F.lit(7), where=(5, 5)).head()[0] == 7


def test_reduce_operators(spark):
    a = array(spark, [6, 3, 5])
    expected = {"plus": 14, "multiply": 90, "min": 3, "max": 6, "bit_and": 0, "bit_or": 7, "bit_xor": 0, "first": 6, "second": 5, "logical_and": True, "logical_or": True, "logical_xor": True}
    assert {n: alg.reduce(a, op).head()[0] for n, op in OPS.items()} == expected
    join = custom(F.lit(None).cast("string"), lambda s, v: F.coalesce(F.concat(s, F.lit("-"), v.cast("string")), v.cast("string")))
    assert alg.reduce(array(spark, [1, 2, 3, 4]), join).head()[0] == "1-2-3-4"


@pytest.mark.parametrize("units", (1, 3, 8))
def test_extrema_and_ties(spark, units):
    a = array(spark, [5, 2, 9, 2, 9], pattern=Pattern.of((5,), (CYCLIC,), units))
    assert tuple(alg.min_element(a).head()) == (1, 2)
    assert tuple(alg.max_element(a).head()) == (2, 9)
    assert tuple(alg.min_element(a, (2, 5)).head()) == (3, 2)
    assert tuple(alg.min_element(a, (2, 2)).head()) == (None, None)
    assert tuple(alg.minmax(a).head()) == (2, 9)


def test_find_and_quantifiers(spark):
    a = array(spark, [0, 0, 24, 0, 24], pattern=Pattern.of((5,), (CYCLIC,), 2))
    assert alg.find(a, F.lit(24)).head()[0] == 2 and alg.find(a, F.lit(1)).head()[0] is None
    assert alg.find(a, F.lit(24), (3, 5)).head()[0] == 4
    assert alg.find_if_not(a, lambda v: v == 0).head()[0] == 2
    assert alg.find_if(array(spark, [0, 1, 1], pattern=a.pattern), lambda v: v == 1, order="unit").head()[0] == 2
    empty = (0, 0)
    for f, whole, none in ((alg.all_of, False, True), (alg.any_of, True, False), (alg.none_of, False, True)):
        assert f(a, lambda v: v == 24).head()[0] is whole and f(a, lambda v: v == 24, empty).head()[0] is none


def test_equal_and_mismatch(spark):
    a = array(spark, [0] * 10 + [1] * 491 + [0] * 12)
    assert alg.equal(a, a, (10, 500), 11).head()[0] is True
    assert alg.equal(a, a, (9, 400), 10).head()[0] is False
    assert alg.equal(a, a, (9, 400), 10, lambda x, y: x <= y).head()[0] is True
    assert tuple(alg.mismatch(a, a, (9, 400), 10).head()) == (9, 0, 1)
    assert tuple(alg.mismatch(a, a).head()) == (None, None, None)


def test_maps_and_movement(spark):
    a = array(spark, list(range(10)))
    assert values(alg.fill(a, F.lit(7).cast("long"), (2, 4))) == [0, 1, 7, 7, 4, 5, 6, 7, 8, 9]
    assert values(alg.generate(a, 3)) == values(alg.generate(a.with_df(a.df.repartition(3)), 3))
    assert values(alg.for_each_with_index(a, lambda v, g: v + g)) == [2 * i for i in range(10)]
    assert values(alg.transform(a, a, MAX)) == list(range(10))
    assert values(alg.copy(a, a, (0, 3), 5)) == [0, 1, 2, 3, 4, 0, 1, 2, 8, 9]
    updates = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (3, None, 0)], "gidx long, value long, seq int")
    assert values(alg.scatter(a, updates, "seq"))[:4] == [0, 6, 2, None]
    assert values(alg.accumulate(a, updates))[:4] == [0, 12, 2, 3]
    assert values(a.swap(0, 9))[0] == 9
    wanted = spark.createDataFrame([(3,), (3,), (99,)], "gidx long")
    assert sorted((r.gidx, r.value) for r in alg.gather(a, wanted).collect()) == [(3, 3), (3, 3), (99, None)]
    with pytest.raises(IndexError):
        a.at(10)
    assert a.at(4).head().value == 4 and a.to_matrix((2, 5)).element(7).head().value == 7


@pytest.mark.parametrize("units", (1, 4, 11))
def test_sort(spark, units):
    rng = np.random.default_rng(42)
    v = [int(x) for x in rng.integers(-1000, 1000, 100 * units)]
    a = array(spark, v, pattern=Pattern.of((len(v),), (BLOCKCYCLIC(19),), units))
    assert values(alg.sort(a)) == sorted(v)
    assert values(alg.sort(a, (10, 60))) == v[:10] + sorted(v[10:60]) + v[60:]
    assert values(alg.sort(a, key=lambda x: -x)) == sorted(v, reverse=True)


def test_sort_degenerate(spark):
    assert values(alg.sort(array(spark, [3] * 7))) == [3] * 7
    assert values(alg.sort(array(spark, [], pattern=Pattern.of((0,))))) == []
    big = 2**31 - 1
    assert values(alg.sort(array(spark, [big, 0, -big, big]))) == [-big, 0, big, big]


def test_histogram(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 2, 2, 9, 11)], "k int")
    h = alg.histogram(keys, "k", 10)
    assert [r.n for r in h.orderBy("key").collect()] == [1, 0, 2, 0, 0, 0, 0, 0, 0, 1]
    assert [r.total for r in alg.cumulative(h, 10, 3).orderBy("key").collect()] == [1, 1, 3, 3, 3, 3, 3, 3, 3, 4]


def test_statistics(spark):
    a = array(spark, [2.0, 4.0, 6.0], "double")
    assert alg.sigma(a).head()[0] == pytest.approx(np.std([2, 4, 6]))
    assert values(alg.div_mean(a)) == [0.5, 1.0, 1.5]
    assert values(alg.div_mean(array(spark, [-1.0, 1.0], "double"))) == [-1.0, 1.0]


def test_views(spark):
    n = 13 * 4 + 2
    a = array(spark, list(range(n)), pattern=Pattern.of((n,), (BLOCKCYCLIC(3),), 4))
    left, right = views.sub(a, 0, 2 * n // 3), views.sub(a, n // 3, n)
    assert views.intersect(left, right).df.count() == 2 * n // 3 - n // 3
    assert views.difference(left, right).df.count() == n // 3
    assert views.union(left, right).count() == n
    assert [r.value for r in views.sub(views.sub(a, 10, 40), 5, 8).df.orderBy("vidx").collect()] == [15, 16, 17]
    assert views.origin(views.sub(left, 0, 3)) is a and views.domain(left) is a
    assert sorted(r.gidx for r in views.local(a, 1).collect()) == [g for g in range(n) if g // 3 % 4 == 1]
    assert sorted(r.gidx for r in views.block(a, 2).collect()) == [6, 7, 8]
    assert views.strided(a, 10).df.count() == 6
    assert tuple(views.local_index_range(a, 4, 30, 1).head()) == (1, 9)
    m = matrix(spark, np.arange(12).reshape(3, 4))
    assert [r.value for r in views.row(m, 1).df.orderBy("vidx").collect()] == [4, 5, 6, 7]
    assert [r.value for r in views.col(m, 2).df.orderBy("vidx").collect()] == [2, 6, 10]
    assert dense(views.cols(m, 1, 2)).tolist() == [[1, 2], [5, 6], [9, 10]]
    assert tuple(views.bounds(views.rows(m, 1, 2)).head()) == (4, 12, 8)


POINTS = [((-1, 0), 0.5), ((1, 0), 0.25), ((0, -1), 2.0), ((0, 1), 1.0), ((1, 1), -1.0)]
SPEC = stencil.StencilSpec(tuple(stencil.Point(o, w) for o, w in POINTS))


@pytest.mark.parametrize("borders", [("NONE", "NONE"), ("CYCLIC", "CYCLIC"), ("CUSTOM", "CUSTOM"), ("CUSTOM", "CYCLIC"), ("NONE", "CUSTOM"), ("CYCLIC", "NONE")])
def test_stencil_borders(spark, borders):
    m = np.random.default_rng(42).integers(0, 9, (6, 5)).astype(float)
    got = dense(stencil.apply(matrix(spark, m), SPEC, borders, 3.0, lambda c: c[0] * 10 + c[1]))
    for i in range(6):
        for j in range(5):
            total = 3 * m[i, j]
            for (di, dj), w in POINTS:
                at, out = [i + di, j + dj], []
                for d, e in enumerate(m.shape):
                    if not 0 <= at[d] < e:
                        out.append(borders[d])
                        at[d] = at[d] % e if borders[d] == "CYCLIC" else at[d]
                total += np.nan if "NONE" in out else w * (at[0] * 10 + at[1]) if "CUSTOM" in out else w * m[tuple(at)]
            assert got[i, j] == pytest.approx(total, nan_ok=True)


def test_stencil_forms(spark):
    m = np.arange(20.0).reshape(4, 5)
    a = matrix(spark, m)
    full = stencil.StencilSpec.full(2)
    assert len(full.points) == 8 and full.total() == ((-1, 1), (-1, 1))
    assert np.nanmax(dense(stencil.folded(a, full, ("NONE", "NONE"), MAX))) == 18 or dense(stencil.folded(a, full, ("NONE", "NONE"), MAX))[2, 3] == 19
    assert dense(stencil.blur(a))[0, 0] == 0 and dense(stencil.blur(a))[1, 1] == pytest.approx(0.4 * 6 + 0.15 * (1 + 11 + 5 + 7))
    ones = dense(stencil.scattered(matrix(spark, np.ones((3, 3))), full, ("NONE", "NONE"), F.col("value"), 0.0))
    assert ones.tolist() == [[3, 5, 3], [5, 8, 5], [3, 5, 3]]
    placed = GridArray(a.df, Pattern.of((4, 5), (BLOCKED, NONE), 2))
    assert stencil.scope(placed, stencil.StencilSpec((stencil.Point((1, 0)),))).where("inner").count() == 10


@pytest.mark.parametrize("block", (3, 1000))
def test_shifted(spark, block):
    a = array(spark, [float(i * i) for i in range(20)], "double")
    rows = {r.gidx: (r.s0, r.s1) for r in stencil.shifted(a, (-2, 1), block).collect()}
    assert len(rows) == 20
    assert all(rows[g] == (float((g - 2) ** 2) if g >= 2 else None, float((g + 1) ** 2) if g < 19 else None) for g in range(20))


def test_iterations(spark):
    v = np.random.default_rng(1).random(12)
    a = array(spark, [float(x) for x in v], "double")
    w = v.copy()
    for _ in range(3):
        w[1:-1] = 0.25 * w[:-2] + 0.5 * w[1:-1] + 0.25 * w[2:]
    assert values(stencil.jacobi_1d(a, 3, every=2)) == pytest.approx(list(w))
    m = np.random.default_rng(2).random((5, 4))
    h = m.copy()
    for _ in range(3):
        h = h + 0.1 * (np.roll(h, 1, 0) + np.roll(h, -1, 0) - 2 * h) + 0.1 * (np.roll(h, 1, 1) + np.roll(h, -1, 1) - 2 * h)
    out = dense(stencil.heat(matrix(spark, m), 3, every=2))
    assert np.allclose(out, h) and out.sum() == pytest.approx(m.sum())


@pytest.mark.parametrize("tile", (2, 7, 64))
def test_matmul(spark, tile):
    rng = np.random.default_rng(3)
    x, y = rng.random((9, 7)), rng.random((7, 11))
    assert np.allclose(dense(linalg.matmul(matrix(spark, x), matrix(spark, y), tile)), x @ y)
    assert np.allclose(dense(linalg.matmul_sparse(matrix(spark, x), matrix(spark, y))), x @ y)
    assert np.allclose(dense(linalg.matmul(matrix(spark, x), matrix(spark, np.eye(7)), tile)), x)
    with pytest.raises(ValueError):
        linalg.matmul(matrix(spark, x), matrix(spark, x))


def test_maps(spark):
    rows = [(100 * (u + 1) + k, float(t), 4 * t + u) for t in (0, 1) for u in range(4) for k in (1, 2)]
    batch = spark.createDataFrame(rows, "key long, mapped double, seq long")
    m = keyed.insert_first_wins(batch)
    assert m.count() == 8 and m.agg(F.max("mapped")).head()[0] == 0.0
    assert keyed.insert_flags(batch).where("inserted").count() == 8 and keyed.insert_flags(batch, m).where("inserted").count() == 0
    more = spark.createDataFrame([(101, 9.0, 1), (999, 9.0, 2)], "key long, mapped double, seq long")
    assert keyed.insert_first_wins(more, m).where("key = 101").head().mapped == 0.0
    found = {r.key: (r.found, r.mapped) for r in keyed.lookup(m, more.select("key"), F.lit(-1.0)).collect()}
    assert found == {101: (True, 0.0), 999: (False, -1.0)}
    with pytest.raises(KeyError):
        keyed.at(m, 5)
    assert keyed.erase(m, more.select("key")).count() == 7


def test_atomics(spark):
    u = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7)], "gidx long, seq long, value long")
    start = spark.createDataFrame([(0, 100)], "gidx long, value long")
    assert sorted((r.gidx, r.seq, r.fetched) for r in keyed.fetch_add(u, start).collect()) == [(0, 1, 100), (0, 2, 105), (1, 1, 0)]
    assert sorted((r.gidx, r.value) for r in keyed.store_last(u).collect()) == [(0, 6), (1, 7)]
    assert {(r.gidx, r.seq): r.fetched for r in keyed.exchange(u).collect()} == {(0, 1): None, (0, 2): 5, (1, 1): None}
    c = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 9, 4), (0, 3, 3, 8)], "gidx long, seq long, expected long, desired long")
    assert tuple(keyed.compare_exchange(c, F.lit(0).cast("long")).head()) == (0, 8, 2)


def test_lists_and_coarrays(spark):
    empty = spark.createDataFrame([], "unit int, lseq long, value int")
    more = spark.createDataFrame([(0, 2, 30), (0, 1, 20), (1, 1, 5)], "unit int, seq long, value int")
    once = keyed.push_back(empty, more)
    assert sorted(map(tuple, keyed.push_back(once, more).collect())) == [(0, 0, 20), (0, 1, 30), (0, 2, 20), (0, 3, 30), (1, 0, 5), (1, 1, 5)]
    c = spark.createDataFrame([(image, i, 2) for image in range(3) for i in range(4)], "image int, i int, value int")
    assert {r.value for r in keyed.coreduce(c, ["i"]).collect()} == {6} and keyed.coreduce(c, ["i"], images=3).count() == 12
    assert keyed.cobroadcast(c, 1, 5).count() == 20 and keyed.counter_get(c).head()[0] == 24


def test_collectives(spark):
    a = array(spark, list(range(12))).df
    dealt = collectives.scatter(a, 4)
    assert sorted(map(tuple, collectives.gather(dealt, 4).collect())) == [(i, i) for i in range(12)]
    assert collectives.allgather(dealt, 4, 3).count() == 36
    assert {r.unit: r["values"] for r in collectives.gather_lists(dealt).collect()} == {u: list(range(4 * u, 4 * u + 4)) for u in range(3)}
    ring = collectives.sendrecv(spark.createDataFrame([(0, 1), (2, 3)], "unit int, value int"), 3)
    assert sorted(map(tuple, ring.collect())) == [(0, 3), (1, 1)]
    top = collectives.max_location(spark.createDataFrame([(u, 10 * 4 + u) for u in range(4)], "unit int, value int"))
    assert tuple(top.head()) == (43, 3)


def test_minimum_degree(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 3)], "src long, dst long")
    got = [tuple(r) for r in graph.minimum_degree_order(edges).orderBy("step").collect()]
    assert got == [(0, 0, 1), (1, 1, 2), (2, 2, 1), (3, 3, 0)]


def test_storage(spark, tmp_path):
    path = str(tmp_path)
    a = array(spark, [float(i) for i in range(8)], "double", Pattern.of((8,), (TILE(2),), 2))
    store = storage.ArrayStore(spark, path)
    store.dataset("group/one") << a
    back = store.dataset("group/one").read()
    assert values(back) == values(a) and back.pattern == a.pattern
    m = matrix(spark, np.arange(6).reshape(2, 3))
    store.dataset("m").by_block() << m
    assert dense(store.dataset("m").read()).tolist() == [[0, 1, 2], [3, 4, 5]]
    store.dataset("bare").store_pattern(False).converter(lambda v: v.cast("int")) << a
    assert store.dataset("bare").read().size == 8
    s = GridArray.of(spark.range(3), "id", F.struct(F.lit(1.0).alias("a"), F.lit(2).alias("b")), 3)
    store.dataset("s") << s
    assert values(store.dataset("s").read().member("b")) == [2, 2, 2]


def test_texts(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 3\n1 1\n2 1\n3 2\n")
    assert sorted(map(tuple, storage.read_matrix_market(spark, str(tmp_path / "g.mtx")).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    (tmp_path / "g.adj").write_text("0 1 3 4\n1 0 2 1\n")
    assert sorted(map(tuple, storage.read_adjacency(spark, str(tmp_path / "g.adj")).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    lines = [r.text for r in storage.pgm_lines(matrix(spark, [[0, 300], [1.6, -5]])).orderBy("line").collect()]
    assert lines == ["P2", "2 2", "255", "0 255", "2 0"]
