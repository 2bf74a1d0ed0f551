"""Queries of units and teams, views, element-wise odds and ends, atomics, maps, graphs and array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.catalogue import GRID, grid, orders, query
from tessera.functions import arrays
from tessera.operators import algorithms as alg
from tessera.operators import collectives, graph, keyed, views
from tessera.operators.array import GridArray
from tessera.operators.reduce_ops import BIT_XOR, MAX, MULTIPLY
from tessera.plans.patterns import BLOCKED, BLOCKCYCLIC, IrregularPattern, Pattern, iterate, long, make_pattern
from tessera.plans.teams import Domain, Team, TeamSpec, balance_extents, factorize
from tessera.session import table

# element access and element-wise maps


@query("SELECT o_orderkey AS gidx, (o_orderkey // 8) % 5 = 2 AS is_local FROM orders")
def is_local(spark, d):
    a = orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(8),), 5))
    return a.df.select("gidx", a.pattern.is_local(a.coords, 2).alias("is_local"))


@query("SELECT count(*) * 64 AS size, count(*) AS rows, 64::BIGINT AS cols, 2::BIGINT AS dims, 40 * 64 + 7 - (3 * 64 + 5)::BIGINT AS distance FROM embeddings")
def array_metadata(spark, d):
    """Size, extents, and the distance from cell (3, 5) to cell (40, 7)."""
    g = grid(spark, d)
    place = lambda i, j: g.pattern.linear([long(i), long(j)])
    known = (long(g.size).alias("size"), long(g.pattern.extents[0]).alias("rows"), long(g.pattern.extents[1]).alias("cols"), long(g.ndim).alias("dims"))
    return spark.range(1).select(*known, (place(40, 7) - place(3, 5)).alias("distance"))


_ROUND = "(xor({x}, {x} >> 13) + 1) * {m} % 2147483647"


@query(f"""WITH a AS (SELECT o_orderkey AS gidx, (o_orderkey + 42) % 2147483647 AS x FROM orders), b AS (SELECT gidx, {_ROUND.format(x='x', m=48271)} AS x FROM a),
       c AS (SELECT gidx, {_ROUND.format(x='x', m=69621)} AS x FROM b) SELECT gidx, {_ROUND.format(x='x', m=16807)} / 2147483647.0::DOUBLE AS value FROM c""")
def generate_seeded(spark, d):
    return alg.generate(orders(spark, d), 42).df


@query("SELECT o_orderkey AS gidx, o_totalprice::DOUBLE AS value, true AS refused FROM orders")
def converted_values(spark, d):
    """Values copied to an array of the same type, and not to one of another size."""
    a = orders(spark, d)
    try:
        alg.converted(a, "float")
        refused = False
    except TypeError:
        refused = True
    return alg.converted(a, "double").df.withColumn("refused", F.lit(refused))


# views


@query(f"WITH {GRID} SELECT i0 - 5 AS i0, i1, i0 * 64 + i1 AS gidx, value FROM g WHERE i0 >= 5 AND i0 < 12")
def view_rows(spark, d):
    return views.rows(grid(spark, d), 5, 7).df.select("i0", "i1", "gidx", "value")


@query(f"WITH {GRID} SELECT i0, i1 - 60 AS i1, i0 * 64 + i1 AS gidx, value FROM g WHERE i1 >= 60")
def view_cols(spark, d):
    return views.cols(grid(spark, d), 60, 10).df.select("i0", "i1", "gidx", "value")


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey >= 4 AND (o_orderkey - 4) % 9 = 0")
def view_strided(spark, d):
    return views.strided(orders(spark, d), 9, 4).df.select("gidx", "value")


@query("SELECT o_orderkey AS gidx FROM orders WHERE o_orderkey >= 150 AND o_orderkey < 250")
def view_index(spark, d):
    return views.index(views.sub(views.sub(orders(spark, d), 100, 400), 50, 150))


@query("SELECT count(*) AS origin_size, least(300, count(*) - 100) AS domain_size, 100::BIGINT AS view_size FROM orders")
def view_domain_and_origin(spark, d):
    v = views.sub(views.sub(orders(spark, d), 100, 400), 50, 150)
    return spark.range(1).select(long(views.origin(v).size).alias("origin_size"), long(views.domain(v).size).alias("domain_size"), long(v.size).alias("view_size"))


@query("SELECT min(o_orderkey) AS first, max(o_orderkey) + 1 AS last, count(*) AS size FROM orders WHERE o_orderkey >= 30 AND o_orderkey < 90")
def view_range(spark, d):
    return views.bounds(views.sub(orders(spark, d), 30, 90))


@query("SELECT k AS place, k // 48 AS x, k // 8 % 6 AS y, k % 8 AS z FROM range(480) t(k)")
def view_cartesian(spark, d):
    x, y, z = views.cartesian(F.col("place"), (10, 6, 8))
    return spark.range(480).withColumnRenamed("id", "place").select("place", x.alias("x"), y.alias("y"), z.alias("z"))


@query("SELECT c_custkey AS gidx, c_custkey - 20 AS vidx, c_acctbal AS value FROM customer WHERE c_custkey >= 20 AND c_custkey < 60")
def view_applied(spark, d):
    """The steps of a view on orders taken on customers."""
    view = views.sub(views.sub(orders(spark, d), 10, 70), 10, 50)
    c = table(spark, d, "customer")
    return views.apply(view, GridArray.of(c, "c_custkey", "c_acctbal", c.count())).df.select("gidx", "vidx", "value")


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey < 50 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 40 AND o_orderkey < 80")
def view_combined(spark, d):
    a = orders(spark, d)
    return views.combine(views.sub(a, 0, 50), views.sub(a, 40, 80))


@query(f"WITH {GRID} SELECT i0 - 8 AS i0, i1 - 6 AS i1, i0 * 64 + i1 AS gidx, value FROM g WHERE i0 >= 8 AND i0 < 20 AND i1 >= 6 AND i1 < 11")
def view_spec(spark, d):
    """A rectangle cut out and resized before it is looked at."""
    g = grid(spark, d)
    spec = views.ViewSpec.of(g.pattern.extents).slice(0, 8, 30).slice(1, 4, 40).resize(0, 12).slice(1, 2, 5)
    return spec.view(g).df.select("i0", "i1", "gidx", "value")


# patterns and teams


@query("SELECT i0 * 30 + i1 AS gidx, i0, i1, ((i0 // 6 + i1 // 7) % 4)::INTEGER AS unit, i0 // 6 * 5 + i1 // 7 AS block FROM range(24) a(i0), range(30) b(i1)")
def pattern_made(spark, d):
    """A pattern asked for by its properties: neighbours of a tile on other units."""
    return iterate(spark, make_pattern((24, 30), 4, {"remote-neighbors"}, (6, 7))).select("gidx", "i0", "i1", "unit", "block")


@query("SELECT * FROM (VALUES ('blocks', true, true), ('cyclic', true, false), ('parts', false, true)) t(pattern, balanced, unimapped)")
def pattern_properties(spark, d):
    kinds = {"blocks": Pattern.of((40,), (BLOCKED,), 4), "cyclic": Pattern.of((40,), (BLOCKCYCLIC(2),), 4), "parts": IrregularPattern((10, 20, 10))}
    rows = [(n, "balanced" in p.properties(), "unimapped" in p.properties()) for n, p in kinds.items()]
    return spark.createDataFrame(rows, "pattern string, balanced boolean, unimapped boolean")


@query("SELECT k AS gidx, CASE WHEN k < 4 THEN 0 WHEN k < 10 THEN 1 ELSE 2 END::INTEGER AS unit, k - CASE WHEN k < 4 THEN 0 WHEN k < 10 THEN 4 ELSE 10 END AS lidx FROM range(25) t(k)")
def pattern_iterated(spark, d):
    return iterate(spark, IrregularPattern((4, 6, 15))).select("gidx", "unit", "lidx")


@query("""SELECT (x * 4 + y)::INTEGER AS unit, CASE WHEN x < 2 THEN (x + 1) * 4 + y END::INTEGER AS below, CASE WHEN y > 0 THEN x * 4 + y - 1 END::INTEGER AS before,
       ((x + 2) % 3 * 4 + (y + 1) % 4)::INTEGER AS around FROM range(3) a(x), range(4) b(y)""")
def team_neighbours(spark, d):
    t = TeamSpec((3, 4))
    rows = [(u, t.neighbor(u, (1, 0)), t.neighbor(u, (0, -1)), t.periodic_neighbor(u, (-1, 1))) for u in range(t.size)]
    return spark.createDataFrame(rows, "unit int, below int, before int, around int")


@query("""SELECT n_nationkey AS unit, (n_nationkey // 9)::INTEGER AS outer_team, (n_nationkey % 9 // CASE n_nationkey // 9 WHEN 2 THEN 4 ELSE 5 END)::INTEGER AS inner_team,
       CASE n_nationkey // 9 WHEN 2 THEN 7 ELSE 9 END::INTEGER AS parent_size, n_nationkey // 9 * 100 + n_nationkey % 9 // CASE n_nationkey // 9 WHEN 2 THEN 4 ELSE 5 END AS path FROM nation""")
def team_nested(spark, d):
    """Nations as units of a team split in three, each part split in two."""
    rows = []
    for outer in Team.all(table(spark, d, "nation").count()).split(3):
        for inner in outer.split(2):
            rows += [(u, outer.position, inner.position, inner.sibling(inner.position).parent.size, inner.path()[0] * 100 + inner.path()[1]) for u in inner.members]
    return spark.createDataFrame(rows, "unit int, outer_team int, inner_team int, parent_size int, path int")


@query("""SELECT n_nationkey AS unit, n_regionkey IN (1, 3) AS selected, n_regionkey <> 2 AS kept, CASE WHEN n_regionkey IN (1, 3) THEN 'pair' ELSE r_name END AS part, (n_regionkey // 3)::INTEGER AS team
       FROM nation JOIN region ON r_regionkey = n_regionkey""")
def team_domains(spark, d):
    """Nations as units, regions as their places: some selected, one left out, two put together, all dealt to two teams."""
    named = {r["r_regionkey"]: r["r_name"] for r in table(spark, d, "region").collect()}  # a region each
    homes: dict[int, list[int]] = {}
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        homes.setdefault(r["n_regionkey"], []).append(r["n_nationkey"])
    world = Domain("world", "global", (), tuple(Domain(named[k], "region", tuple(sorted(v))) for k, v in sorted(homes.items())))
    chosen = world.select({named[1], named[3]}).all_units()
    kept = world.exclude({named[2]}).all_units()
    part = {u: p.name for p in world.group({named[1], named[3]}, "pair").parts for u in p.all_units()}
    team = {u: t.position for t in world.split(2, "region") for u in t.members}
    rows = [(u, u in chosen, u in kept, part[u], team[u]) for u in world.all_units()]
    return spark.createDataFrame(rows, "unit int, selected boolean, kept boolean, part string, team int")


@query("SELECT * FROM (VALUES (12, '2 2 3', 4, 3), (17, '17', 17, 1), (36, '2 2 3 3', 6, 6)) t(units, factors, rows, cols)")
def team_balanced(spark, d):
    rows = []
    for n in (12, 17, 36):
        factors = " ".join(str(p) for p, times in factorize(n).items() for _ in range(times))
        rows.append((n, factors, *balance_extents((n, 1))))
    return spark.createDataFrame(rows, "units int, factors string, rows int, cols int")


# collectives


@query("""WITH p AS (SELECT n_regionkey AS unit, n_nationkey FROM nation WHERE n_nationkey % 5 <> n_regionkey OR n_nationkey < 12)
       SELECT gidx, value, u::INTEGER AS unit FROM (SELECT row_number() OVER (ORDER BY unit, n_nationkey) - 1 AS gidx, n_nationkey::BIGINT AS value FROM p), range(3) t(u)""")
def allgather_unequal(spark, d):
    """Parts of different sizes, one after another, at every unit."""
    n = table(spark, d, "nation").where((F.pmod("n_nationkey", F.lit(5)) != F.col("n_regionkey")) | (F.col("n_nationkey") < 12))
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    parts = n.select(F.col("n_regionkey").alias("unit"), place.alias("lidx"), F.col("n_nationkey").cast("long").alias("value"))
    return collectives.allgatherv(parts, 3).select("gidx", "value", "unit")


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS gidx, o_custkey AS value, CASE WHEN row_number() OVER (ORDER BY o_custkey, o_orderkey) <= 40 THEN 0 WHEN row_number() OVER (ORDER BY o_custkey, o_orderkey) <= 140 THEN 1 ELSE 2 END::INTEGER AS unit FROM orders")
def sort_irregular(spark, d):
    """Sorted over units with parts of 40, 100 and all further cells."""
    a = alg.sort(orders(spark, d, "o_custkey", lambda n: IrregularPattern((40, 100, n - 140))))
    return a.placed().select("gidx", "value", "unit")


# maps


def _inserts(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("value").alias("mapped"), F.col("event_id").alias("seq"))


@query("""WITH n AS (SELECT count(*) AS n FROM events), a AS (SELECT user_id AS key, arg_min(value, event_id) AS mapped FROM events, n WHERE event_id < n // 3 GROUP BY 1)
       SELECT * FROM a UNION ALL SELECT user_id, arg_min(value, event_id) FROM events, n WHERE event_id >= n // 2 AND user_id NOT IN (SELECT key FROM a) GROUP BY 1""")
def map_insert_range(spark, d):
    """A range of insertions, then another one from the middle on; what is there already stays."""
    batch = _inserts(spark, d)
    n = batch.count()
    return keyed.insert_range(batch, n // 2, n, keyed.insert_range(batch, 0, n // 3))


@query("SELECT user_id AS key, arg_min(value, event_id) AS mapped FROM events GROUP BY 1")
def map_insert_hinted(spark, d):
    batch = _inserts(spark, d).withColumn("hint", F.col("key") - 1)
    return keyed.insert_hinted(keyed.insert_first_wins(batch.where("seq < 100").drop("hint")), batch.where("seq >= 100"))


@query("SELECT user_id AS key, (arg_min(event_id, event_id) + sum(length(event_type)))::BIGINT AS mapped FROM events GROUP BY 1")
def map_mapped_atomics(spark, d):
    """Values of a map added to in place, many times each."""
    e = table(spark, d, "events")
    m = keyed.insert_first_wins(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("mapped"), F.col("event_id").alias("seq")))
    return keyed.update_mapped(m, e.select(F.col("user_id").alias("key"), F.length("event_type").cast("long").alias("value"), F.col("event_id").alias("seq")))


@query("SELECT DISTINCT user_id AS key, (user_id % 6)::INTEGER AS unit FROM events")
def map_bucket(spark, d):
    return keyed.bucket(keyed.insert_first_wins(_inserts(spark, d)), 6, whole=True).select("key", "unit")


# atomics


def _updates(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("gidx"), F.col("event_id").alias("seq"), F.length("event_type").cast("long").alias("value"))


_BEFORE = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT user_id AS gidx, event_id AS seq, (1000 - coalesce(sum(length(event_type)) {_BEFORE}, 0))::BIGINT AS fetched FROM events")
def atomic_fetch_sub(spark, d):
    cells = _updates(spark, d).select("gidx").distinct().withColumn("value", long(1000))
    return keyed.fetch_sub(_updates(spark, d), cells).select("gidx", "seq", "fetched")


@query(f"SELECT user_id AS gidx, event_id AS seq, (3 * coalesce(product(CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END) {_BEFORE}, 1))::DOUBLE AS fetched FROM events")
def atomic_fetch_multiply(spark, d):
    u = _updates(spark, d).withColumn("value", F.when(F.pmod("seq", long(50)) == 0, 2.0).otherwise(1.0))
    return keyed.fetch_op(u, op=MULTIPLY, start=F.lit(3.0)).select("gidx", "seq", "fetched")


@query(f"SELECT user_id AS gidx, event_id AS seq, greatest(2, max(length(event_type)) {_BEFORE})::BIGINT AS fetched FROM events")
def atomic_fetch_max(spark, d):
    return keyed.fetch_op(_updates(spark, d), op=MAX, start=long(2)).select("gidx", "seq", "fetched")


@query("""WITH RECURSIVE u AS (SELECT user_id AS gidx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, length(event_type) % 3 AS expected, (length(event_type) + event_id) % 3 AS desired FROM events),
       r AS (SELECT DISTINCT gidx, 0::BIGINT AS k, 0::BIGINT AS value, 0::BIGINT AS n FROM u UNION ALL
             SELECT r.gidx, u.k, CASE WHEN r.value = u.expected THEN u.desired ELSE r.value END, r.n + (r.value = u.expected)::BIGINT FROM r JOIN u ON u.gidx = r.gidx AND u.k = r.k + 1)
       SELECT gidx, arg_max(value, k) AS value, arg_max(n, k) AS n FROM r GROUP BY 1""")
def atomic_compare_exchange(spark, d):
    """Cells go from one state to another only where they are in the state that an update expects."""
    size = F.length("event_type").cast("long")
    u = table(spark, d, "events").select(F.col("user_id").alias("gidx"), F.col("event_id").alias("seq"), F.pmod(size, long(3)).alias("expected"), F.pmod(size + F.col("event_id"), long(3)).alias("desired"))
    return keyed.compare_exchange(u, long(0))


@query("SELECT 0::BIGINT AS wrong, count(*) AS cells FROM orders")
def random_access_verified(spark, d):
    """The random updates made twice give the table back: how many cells are wrong then."""
    a = orders(spark, d, "o_custkey")
    updates = table(spark, d, "lineitem").select(F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), long(a.size)).alias("gidx"), F.col("l_partkey").alias("value"))
    twice = alg.accumulate(alg.accumulate(a, updates, BIT_XOR), updates, BIT_XOR)
    return alg.transform(twice, a, lambda x, y: (x != y).cast("long")).df.agg(F.sum("value").alias("wrong"), F.count("*").alias("cells"))


# graphs


@query("""WITH e AS (SELECT n_nationkey AS node, n_nationkey AS moment, 0 AS late, 1 AS degree FROM nation UNION ALL SELECT 100 + n_regionkey, max(n_nationkey), 1, 0 FROM nation GROUP BY n_regionkey)
       SELECT row_number() OVER (ORDER BY moment, late) - 1 AS step, node::BIGINT AS node, degree::BIGINT AS degree FROM e""")
def minimum_degree(spark, d):
    """The tree of nations and regions: leaves go first, a region right after its last nation."""
    n = table(spark, d, "nation")
    return graph.minimum_degree_order(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst")))


@query("SELECT a AS node, count(*) AS degree FROM (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey % 7 AS b FROM orders UNION SELECT 1000000 + o_orderkey % 7, o_custkey FROM orders) GROUP BY 1")
def graph_degrees(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.pmod("o_orderkey", long(7)) + 1_000_000).alias("dst"))
    return graph.degrees(graph.symmetric(e)).select(F.col("src").alias("node"), "degree")


# array expressions


@query("""SELECT vec_id, len(embedding[2:]) AS tail_n, len(list_append(embedding, 1.5::FLOAT)) AS appended_n, list_append(embedding, 1.5::FLOAT)[-1]::DOUBLE AS appended_last,
       len(embedding || embedding[1:3]) AS joined_n, round(embedding[8]::DOUBLE, 6) AS left_last, round(embedding[9]::DOUBLE, 6) AS right_first FROM embeddings""")
def array_rearranged(spark, d):
    e = F.col("embedding").cast("array<double>")
    longer, parts = arrays.append(e, F.lit(1.5)), arrays.split_at(e, 8)
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return table(spark, d, "embeddings").select(
        "vec_id", n(arrays.tail(e), "tail_n"), n(longer, "appended_n"), F.element_at(longer, -1).alias("appended_last"),
        n(arrays.concat(e, arrays.take(e, 3)), "joined_n"), F.round(F.element_at(parts["left"], -1), 6).alias("left_last"), F.round(arrays.head(parts["right"]), 6).alias("right_first"),
    )


@query("""SELECT p_partkey, 100 - p_size - 3 - 2 AS minus, round(1e6 / p_size / 3 / 2, 6) AS divides, round(power(power(power(1.5, p_size % 4), 3), 2), 4) AS power, least(40, p_size, 3, 2)::BIGINT AS minimum FROM part""")
def array_folds(spark, d):
    of = lambda x: F.array(x.cast("double"), F.lit(3.0), F.lit(2.0))
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", arrays.fold(of(size), "minus", F.lit(100.0)).cast("int").alias("minus"), F.round(arrays.fold(of(size), "divides", F.lit(1e6)), 6).alias("divides"),
        F.round(arrays.fold(of(F.pmod(size, F.lit(4))), "power", F.lit(1.5)), 4).alias("power"), arrays.fold(of(size), "minimum", F.lit(40.0)).cast("long").alias("minimum"),
    )
