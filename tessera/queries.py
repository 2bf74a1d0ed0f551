"""The catalogue: each operator as a query on the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import GRID as _GRID
from tessera.catalogue import ORACLE_SQL, QUERIES, events, grid, orders, query
from tessera.functions import arrays
from tessera.operators import algorithms as alg
from tessera.operators import collectives, keyed, linalg, stencil, views
from tessera.operators.array import GridArray
from tessera.operators.reduce_ops import BIT_AND, BIT_OR, BIT_XOR, FIRST, LOGICAL_AND, LOGICAL_OR, LOGICAL_XOR, MAX, MIN, OPS, PLUS, SECOND, custom
from tessera.plans.patterns import BLOCKED, BLOCKCYCLIC, CYCLIC, NONE, TILE, IrregularPattern, Pattern, SeqTilePattern, ShiftTilePattern, TilePattern, long
from tessera.session import table
from tessera.streaming.running import windowed_reduce

_WRAPPED = "wrapped_{g} AS (SELECT *, (i0 + n - 1) % n AS up, (i0 + 1) % n AS down, (i1 + 63) % 64 AS west, (i1 + 1) % 64 AS east FROM {g}, (SELECT max(i0) + 1 AS n FROM {g}))"
_PLACED = "SELECT gidx, unit::INTEGER AS unit, lidx::BIGINT AS lidx FROM"


# reductions


@query("""SELECT unit::INTEGER AS unit, count(*) AS n, min(v) AS low, max(v) AS high, arg_min(k, struct_pack(v := v, k := k)) AS low_at,
       (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS first_of_all
       FROM (SELECT o_orderkey AS k, o_totalprice AS v, o_orderkey // ((SELECT count(*) + 3 FROM orders) // 4) AS unit FROM orders) GROUP BY unit""")
def array_summary(spark, d):
    a = orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKED,), 4))
    first = F.min(F.struct("value", "gidx"))["gidx"]
    by_unit = a.placed().groupBy("unit").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), first.alias("low_at"))
    return by_unit.crossJoin(F.broadcast(alg.min_element(a).select(F.col("idx").alias("first_of_all"))))  # one row


@query("SELECT (10 + sum(l_quantity))::DOUBLE AS value FROM lineitem")
def reduce_sum(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_quantity").alias("value"), F.lit(0).cast("long").alias("gidx"))
    return alg.reduce(GridArray(df, Pattern.of((1,))), PLUS, F.lit(10.0))


@query("SELECT least(1e9, min(o_totalprice)) AS value FROM orders")
def reduce_min(spark, d):
    return alg.reduce(orders(spark, d), MIN, F.lit(1e9))


@query("SELECT greatest(0.0, max(o_totalprice)) AS value FROM orders")
def reduce_max(spark, d):
    return alg.reduce(orders(spark, d), MAX, F.lit(0.0))


@query("SELECT (3 * product(CASE WHEN o_orderkey % 1000 = 0 THEN 2 ELSE 1 END))::DOUBLE AS value FROM orders")
def reduce_product(spark, d):
    a = orders(spark, d, F.when(F.pmod("o_orderkey", long(1000)) == 0, 2.0).otherwise(1.0))
    return alg.reduce(a, OPS["multiply"], F.lit(3.0))


@query("SELECT bit_and(o_orderkey + 8)::BIGINT AS all_bits, bit_or(o_orderkey)::BIGINT AS any_bits, bit_xor(o_orderkey)::BIGINT AS odd_bits FROM orders")
def reduce_bits(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("gidx"))
    v, g = F.col("value"), F.col("gidx")
    return df.agg(BIT_AND.many(v + 8, g).alias("all_bits"), BIT_OR.many(v, g).alias("any_bits"), BIT_XOR.many(v, g).alias("odd_bits"))


@query("SELECT arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders")
def reduce_first_second(spark, d):
    a = orders(spark, d)
    return a.df.agg(FIRST.many(F.col("value"), F.col("gidx")).alias("first_value"), SECOND.many(F.col("value"), F.col("gidx")).alias("last_value"))


@query("SELECT bool_and(p_size > 0) AS all_true, bool_or(p_size > 49) AS any_true, (count(*) FILTER (p_size > 25)) % 2 = 1 AS odd_true FROM part")
def reduce_logical(spark, d):
    df, g = table(spark, d, "part"), F.col("p_partkey")
    return df.agg(LOGICAL_AND.many(F.col("p_size") > 0, g).alias("all_true"), LOGICAL_OR.many(F.col("p_size") > 49, g).alias("any_true"), LOGICAL_XOR.many(F.col("p_size") > 25, g).alias("odd_true"))


@query("SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def minmax_pair(spark, d):
    return alg.minmax(orders(spark, d))


@query("""SELECT (o_orderkey // 500)::INTEGER AS unit, string_agg(o_orderpriority[1:1], '-' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1""")
def reduce_custom_concat(spark, d):
    a = orders(spark, d, F.substring("o_orderpriority", 1, 1))
    join = custom(F.lit(None).cast("string"), lambda s, v: F.coalesce(F.concat(s, F.lit("-"), v), v), "concat")
    part = a.df.withColumn("unit", F.expr("gidx div 500").cast("int"))
    return part.groupBy("unit").agg(join.many(F.col("value"), F.col("gidx")).alias("value"))


@query("SELECT (o_orderkey % 7)::INTEGER AS unit, sum(o_custkey)::BIGINT AS value FROM orders GROUP BY 1")
def reduce_by_unit(spark, d):
    return alg.reduce(orders(spark, d, "o_custkey", lambda n: Pattern.of((n,), (CYCLIC,), 7)), PLUS, by="unit")


@query("SELECT o_orderkey AS idx, o_totalprice AS value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def min_element(spark, d):
    return alg.min_element(orders(spark, d))


@query("SELECT o_orderkey AS idx, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def max_element(spark, d):
    return alg.max_element(orders(spark, d))


@query("SELECT o_orderkey AS idx, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_totalprice, o_orderkey LIMIT 1")
def min_element_range(spark, d):
    return alg.min_element(orders(spark, d), (100, 900))


@query("SELECT p_partkey AS idx, p_size AS value FROM part ORDER BY abs(p_size - 25), p_partkey LIMIT 1")
def min_element_by_key(spark, d):
    df = table(spark, d, "part")
    return alg.min_element(GridArray.of(df, "p_partkey", "p_size", df.count()), key=lambda v: F.abs(v - 25))


@query("SELECT max(n)::BIGINT AS value, arg_max(unit, struct_pack(n := n, u := -unit))::INTEGER AS unit FROM (SELECT o_orderkey % 5 AS unit, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1)")
def max_with_location(spark, d):
    counts = table(spark, d, "orders").groupBy(F.pmod("o_orderkey", long(5)).cast("int").alias("unit")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("value"))
    return collectives.max_location(counts)


@query("SELECT round(stddev_pop(o_totalprice), 4) AS sigma FROM orders")
def sigma(spark, d):
    return alg.sigma(orders(spark, d)).select(F.round("sigma", 4).alias("sigma"))


@query("SELECT o_orderkey AS gidx, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 6) AS value FROM orders")
def div_mean(spark, d):
    return alg.div_mean(orders(spark, d)).df.select("gidx", F.round("value", 6).alias("value"))


# searches and comparisons


@query("SELECT min(p_partkey) AS idx FROM part WHERE p_size = 24")
def find_first(spark, d):
    df = table(spark, d, "part")
    return alg.find(GridArray.of(df, "p_partkey", "p_size", df.count()), F.lit(24))


@query("SELECT min(o_orderkey) AS idx FROM orders WHERE o_totalprice > 400000 AND o_orderkey >= 50")
def find_if(spark, d):
    return alg.find_if(orders(spark, d), lambda v: v > 400000, (50, 1 << 62))


@query("SELECT min(p_partkey) AS idx FROM part WHERE NOT p_size < 40")
def find_if_not(spark, d):
    df = table(spark, d, "part")
    return alg.find_if_not(GridArray.of(df, "p_partkey", "p_size", df.count()), lambda v: v < 40)


@query("SELECT arg_min(o_orderkey, struct_pack(u := o_orderkey % 4, l := o_orderkey // 4)) AS idx FROM orders WHERE o_totalprice > 300000")
def find_if_unit_order(spark, d):
    return alg.find_if(orders(spark, d, pattern=lambda n: Pattern.of((n,), (CYCLIC,), 4)), lambda v: v > 300000, order="unit")


@query("SELECT bool_and(p_size > 0) AS all_of, bool_or(p_size > 60) AS any_of, NOT bool_or(p_size > 60) AS none_of FROM part")
def quantifiers(spark, d):
    df = table(spark, d, "part")
    a = GridArray.of(df, "p_partkey", "p_size", df.count())
    return alg.quantified(a, all_of=lambda v: v > 0, any_of=lambda v: v > 60, none_of=lambda v: v > 60)


@query("SELECT bool_and(a.event_type IS NOT DISTINCT FROM b.event_type) AS result FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def equal_shifted(spark, d):
    df = table(spark, d, "events")
    a = GridArray.of(df, "event_id", "event_type", df.count())
    return alg.equal(a, a, (0, a.size - 1), 1)


@query("SELECT bool_and(abs(a.o_totalprice - b.o_totalprice) < 495000) AS result FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def equal_predicate(spark, d):
    a = orders(spark, d)
    return alg.equal(a, a, (0, a.size - 1), 1, lambda x, y: F.abs(x - y) < 495000)


@query("""SELECT a.event_id AS idx, a.value AS a, b.value AS b FROM events a JOIN events b ON b.event_id = a.event_id + 3
       WHERE a.value IS DISTINCT FROM b.value ORDER BY 1 LIMIT 1""")
def mismatch(spark, d):
    a = events(spark, d)
    return alg.mismatch(a, a, (0, a.size - 3), 3)


# element-wise maps and movement


@query("SELECT o_orderkey AS gidx, CASE WHEN o_orderkey >= 10 AND o_orderkey < 200 THEN 7.0 ELSE o_totalprice END::DOUBLE AS value FROM orders")
def fill_range(spark, d):
    return alg.fill(orders(spark, d), F.lit(7.0), (10, 200)).df


@query("SELECT o_orderkey AS gidx, o_orderkey * 3 + 1 AS value FROM orders")
def generate_index(spark, d):
    return alg.generate_with_index(orders(spark, d), lambda g: g * 3 + 1).df


@query("SELECT o_orderkey AS gidx, round(o_totalprice * 2 + 1, 4) AS value FROM orders")
def for_each(spark, d):
    return alg.for_each(orders(spark, d), lambda v: F.round(v * 2 + 1, 4)).df


@query("SELECT o_orderkey AS gidx, round(o_totalprice + o_orderkey, 4) AS value FROM orders")
def for_each_index(spark, d):
    return alg.for_each_with_index(orders(spark, d), lambda v, g: F.round(v + g, 4)).df


@query("SELECT o_orderkey AS gidx, o_custkey + o_orderkey AS value FROM orders")
def transform_plus(spark, d):
    return alg.transform(orders(spark, d, "o_custkey"), orders(spark, d, "o_orderkey"), PLUS).df


@query("SELECT o_orderkey AS gidx, greatest(o_custkey, o_orderkey) AS value FROM orders")
def transform_max(spark, d):
    return alg.transform(orders(spark, d, "o_custkey"), orders(spark, d, "o_orderkey"), MAX).df


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def copy_to_local(spark, d):
    return views.sub(orders(spark, d), 100, 300).df.select("gidx", "value")


@query("""SELECT t.o_orderkey AS gidx, CASE WHEN t.o_orderkey >= 500 AND t.o_orderkey < 700 THEN s.o_totalprice ELSE t.o_totalprice END AS value
       FROM orders t LEFT JOIN orders s ON s.o_orderkey = t.o_orderkey - 400""")
def copy_range(spark, d):
    a = orders(spark, d)
    return alg.copy(a, a, (100, 300), 500).df


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey >= 3 AND (o_orderkey - 3) % 16 = 0")
def gather_strided(spark, d):
    return alg.gather_strided(orders(spark, d), 3, 16)


@query("SELECT o_orderkey AS place, o_custkey AS gidx, c_acctbal AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def gather_indexed(spark, d):
    df = table(spark, d, "customer")
    a = GridArray.of(df, "c_custkey", "c_acctbal", df.count())
    return alg.gather(a, table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("gidx"))).select("place", "gidx", "value")


@query("""SELECT o_orderkey AS gidx, coalesce(m, o_totalprice) AS value FROM orders
       LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def scatter_update(spark, d):
    updates = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gidx"), F.col("l_quantity").alias("value"))
    return alg.scatter(orders(spark, d), updates).df


@query("""SELECT o_orderkey AS gidx, (o_custkey + coalesce(q, 0))::DOUBLE AS value FROM orders
       LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def accumulate_sum(spark, d):
    updates = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gidx"), F.col("l_quantity").alias("value"))
    return alg.accumulate(orders(spark, d, F.col("o_custkey").cast("double")), updates).df


@query("SELECT CASE o_orderkey WHEN 3 THEN 8 WHEN 8 THEN 3 ELSE o_orderkey END AS gidx, o_totalprice AS value FROM orders")
def swap_elements(spark, d):
    return orders(spark, d).swap(3, 8).df


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey = 17")
def element_access(spark, d):
    return orders(spark, d).at(17)


@query("SELECT vec_id AS i0, 5::BIGINT AS i1, embedding[6]::DOUBLE AS value FROM embeddings WHERE vec_id = 7")
def matrix_element(spark, d):
    return grid(spark, d).at(7, 5)


@query("SELECT o_orderkey AS gidx, o_custkey AS value FROM orders")
def struct_member(spark, d):
    return orders(spark, d, F.struct(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))).member("c").df


# patterns


def _placed(a: GridArray) -> DataFrame:
    return a.placed().select("gidx", "unit", F.col("lidx").cast("long").alias("lidx"))


@query(f"{_PLACED} (SELECT o_orderkey AS gidx, o_orderkey // b AS unit, o_orderkey % b AS lidx FROM orders, (SELECT (count(*) + 6) // 7 AS b FROM orders))")
def pattern_blocked(spark, d):
    return _placed(orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKED,), 7)))


@query(f"{_PLACED} (SELECT o_orderkey AS gidx, o_orderkey % 7 AS unit, o_orderkey // 7 AS lidx FROM orders)")
def pattern_cyclic(spark, d):
    return _placed(orders(spark, d, pattern=lambda n: Pattern.of((n,), (CYCLIC,), 7)))


@query(f"{_PLACED} (SELECT o_orderkey AS gidx, (o_orderkey // 5) % 7 AS unit, o_orderkey // 35 * 5 + o_orderkey % 5 AS lidx FROM orders)")
def pattern_blockcyclic(spark, d):
    return _placed(orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(5),), 7)))


def _placed2(a: GridArray) -> DataFrame:
    return a.placed().select("i0", "i1", "unit", "block")


@query(f"WITH {_GRID} SELECT i0, i1, ((i0 // 10) % 2 * 3 + (i1 // 8) % 3)::INTEGER AS unit, (i0 // 10 * 8 + i1 // 8)::BIGINT AS block FROM g")
def pattern_tile_2d(spark, d):
    g = grid(spark, d)
    return _placed2(GridArray(g.df, TilePattern.of(g.pattern.extents, (TILE(10), TILE(8)), team=(2, 3))))


@query(f"WITH {_GRID} SELECT i0, i1, ((i0 // 10 + i1 // 8) % 4)::INTEGER AS unit, (i0 // 10 * 8 + i1 // 8)::BIGINT AS block FROM g")
def pattern_shift_tile(spark, d):
    g = grid(spark, d)
    return _placed2(GridArray(g.df, ShiftTilePattern.of(g.pattern.extents, (TILE(10), TILE(8)), team=(4, 1))))


@query(f"WITH {_GRID} SELECT i0, i1, ((i0 // 10 * 8 + i1 // 8) % 5)::INTEGER AS unit, (i0 // 10 * 8 + i1 // 8)::BIGINT AS block FROM g")
def pattern_seq_tile(spark, d):
    g = grid(spark, d)
    return _placed2(GridArray(g.df, SeqTilePattern.of(g.pattern.extents, (TILE(10), TILE(8)), team=(5, 1))))


@query(f"WITH {_GRID} SELECT i0, i1, (i1 // 16)::INTEGER AS unit, (i0 * 16 + i1 % 16)::BIGINT AS lidx FROM g")
def pattern_block_2d(spark, d):
    g = grid(spark, d)
    a = GridArray(g.df, Pattern.of(g.pattern.extents, (NONE, BLOCKED), team=(1, 4)))
    return a.placed().select("i0", "i1", "unit", F.col("lidx").cast("long").alias("lidx"))


@query(f"""{_PLACED} (SELECT o_orderkey AS gidx, u AS unit, o_orderkey - s AS lidx FROM orders JOIN (
       SELECT u, u * (u + 3) // 2 * 10 AS s, CASE u WHEN 3 THEN 1::BIGINT << 40 ELSE (u + 1) * (u + 4) // 2 * 10 END AS e FROM range(4) t(u)) ON o_orderkey >= s AND o_orderkey < e)""")
def pattern_csr(spark, d):
    return _placed(orders(spark, d, pattern=lambda n: IrregularPattern((20, 30, 40, n - 90))))


@query(f"""{_PLACED} (SELECT o_orderkey AS gidx, u AS unit, o_orderkey - s AS lidx FROM orders, (SELECT count(*) AS n FROM orders) c JOIN (
       SELECT 0 AS u, 0.0 AS f, 0.125 AS t UNION ALL SELECT 1, 0.125, 0.25 UNION ALL SELECT 2, 0.25, 0.5 UNION ALL SELECT 3, 0.5, 1.0) p ON true,
       LATERAL (SELECT CASE u WHEN 0 THEN 0 WHEN 1 THEN n // 8 WHEN 2 THEN n // 8 * 2 ELSE n - n // 2 - (n - n // 8 * 2 - n // 4 - n // 2) END AS s,
                CASE u WHEN 0 THEN n // 8 WHEN 1 THEN n // 8 * 2 WHEN 2 THEN n - n // 2 - (n - n // 8 * 2 - n // 4 - n // 2) ELSE n END AS e) WHERE o_orderkey >= s AND o_orderkey < e)""")
def pattern_weighted(spark, d):
    return _placed(orders(spark, d, pattern=lambda n: IrregularPattern.balanced(n, [0.5, 0.5, 1.0, 2.0])))


@query("""SELECT min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest, round(max(n) / avg(n), 6) AS imbalance FROM (
       SELECT (o_orderkey // 64) % 5 AS u, count(*) AS n FROM orders GROUP BY 1)""")
def pattern_metrics(spark, d):
    a = orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(64),), 5))
    return a.placed().groupBy("unit").agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.max("n") / F.avg("n"), 6).alias("imbalance"))


# views


@query(f"WITH {_GRID} SELECT i0 - 10 AS i0, i1 - 4 AS i1, i0 * 64 + i1 AS gidx, value FROM g WHERE i0 >= 10 AND i0 < 30 AND i1 >= 4 AND i1 < 20")
def view_sub_2d(spark, d):
    return views.sub(views.sub(grid(spark, d), 10, 30, 0), 4, 20, 1).df.select("i0", "i1", "gidx", "value")


@query(f"WITH {_GRID} SELECT i1 AS vidx, i0 * 64 + i1 AS gidx, value FROM g WHERE i0 = 12")
def view_row(spark, d):
    return views.row(grid(spark, d), 12).df


@query(f"WITH {_GRID} SELECT i0 AS vidx, i0 * 64 + i1 AS gidx, value FROM g WHERE i1 = 9")
def view_col(spark, d):
    return views.col(grid(spark, d), 9).df


@query("SELECT o_orderkey AS gidx, o_orderkey - 150 AS vidx, o_totalprice AS value FROM orders WHERE o_orderkey >= 150 AND o_orderkey < 250")
def view_chained(spark, d):
    return views.sub(views.sub(orders(spark, d), 100, 400), 50, 150).df.select("gidx", "vidx", "value")


@query("SELECT o_orderkey // 32 AS block, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def view_blocks(spark, d):
    a = orders(spark, d, "o_custkey", lambda n: Pattern.of((n,), (BLOCKCYCLIC(32),), 3))
    return views.blocks(a).groupBy("block").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT o_orderkey AS gidx, o_totalprice AS value, o_orderkey // 96 * 32 + o_orderkey % 32 AS lidx FROM orders WHERE (o_orderkey // 32) % 3 = 1")
def view_local(spark, d):
    return views.local(orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(32),), 3)), 1).select("gidx", "value", F.col("lidx").cast("long").alias("lidx"))


@query("SELECT o_orderkey AS gidx FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 300")
def view_intersect(spark, d):
    a = orders(spark, d)
    return views.intersect(views.sub(a, 0, 300), views.sub(a, 200, 600)).df.select("gidx")


@query("SELECT o_orderkey AS gidx FROM orders WHERE o_orderkey < 200")
def view_difference(spark, d):
    a = orders(spark, d)
    return views.difference(views.sub(a, 0, 300), views.sub(a, 200, 600)).df.select("gidx")


@query("SELECT o_orderkey AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey < 600")
def view_union(spark, d):
    a = orders(spark, d)
    return views.union(views.sub(a, 0, 300), views.sub(a, 200, 600))


@query("SELECT min(l) AS begin, max(l) + 1 AS end FROM (SELECT o_orderkey // 20 * 5 + o_orderkey % 5 AS l FROM orders WHERE (o_orderkey // 5) % 4 = 2 AND o_orderkey >= 33 AND o_orderkey < 333)")
def view_local_range(spark, d):
    a = orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(5),), 4))
    return views.local_index_range(a, 33, 333, 2).select(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


# sorting and histograms


_SORTED = "SELECT row_number() OVER (ORDER BY {k}, o_orderkey) - 1 AS gidx, {v} AS value FROM orders"


@query(_SORTED.format(k="o_totalprice", v="o_totalprice"))
def sort_full(spark, d):
    return alg.sort(orders(spark, d)).df


@query(_SORTED.format(k="o_custkey % 17", v="o_custkey"))
def sort_by_key(spark, d):
    return alg.sort(orders(spark, d, "o_custkey"), key=lambda v: F.pmod(v, long(17))).df


@query("""SELECT 100 + row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS gidx, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900
       UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 100 OR o_orderkey >= 900""")
def sort_partial(spark, d):
    return alg.sort(orders(spark, d), (100, 900)).df


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return alg.histogram(table(spark, d, "lineitem"), "l_quantity", 64)


@query("SELECT k AS key, coalesce(n, 0)::BIGINT AS n FROM range(64) t(k) LEFT JOIN (SELECT l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1) ON q = k")
def histogram(spark, d):
    return _quantities(spark, d)


@query("SELECT k AS key, coalesce(n, 0)::BIGINT AS n, sum(coalesce(n, 0)) OVER (ORDER BY k)::BIGINT AS total FROM range(64) t(k) LEFT JOIN (SELECT l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1) ON q = k")
def histogram_cumulative(spark, d):
    return alg.cumulative(_quantities(spark, d), 64, block=16)


# stencils


@query("""SELECT event_id AS gidx, round(CASE WHEN event_id = 0 OR event_id = (SELECT max(event_id) FROM events) THEN value
       ELSE 0.25 * lag(value) OVER (ORDER BY event_id) + 0.5 * value + 0.25 * lead(value) OVER (ORDER BY event_id) END, 6) AS value FROM events""")
def stencil_1d_jacobi(spark, d):
    return stencil.jacobi_1d(events(spark, d), 1).df.select("gidx", F.round("value", 6).alias("value"))


_STAR = stencil.StencilSpec(tuple(stencil.Point(o, w) for o, w in (((-1, 0), 0.5), ((1, 0), 0.25), ((0, -1), 2.0), ((0, 1), 1.0))))


@query(f"""WITH {_GRID} SELECT c.i0, c.i1, round(3 * c.value + 0.5 * u.value + 0.25 * l.value + 2 * w.value + e.value, 6) AS value FROM g c
       JOIN g u ON u.i0 = c.i0 - 1 AND u.i1 = c.i1 JOIN g l ON l.i0 = c.i0 + 1 AND l.i1 = c.i1 JOIN g w ON w.i0 = c.i0 AND w.i1 = c.i1 - 1 JOIN g e ON e.i0 = c.i0 AND e.i1 = c.i1 + 1""")
def stencil_2d_none(spark, d):
    return _rounded(stencil.apply(grid(spark, d), _STAR, (stencil.NONE, stencil.NONE), 3.0))


@query(f"""WITH {_GRID}, {_WRAPPED.format(g='g')} SELECT c.i0, c.i1, round(3 * c.value + 0.5 * u.value + 0.25 * l.value + 2 * w.value + e.value, 6) AS value FROM wrapped_g c
       JOIN g u ON u.i0 = c.up AND u.i1 = c.i1 JOIN g l ON l.i0 = c.down AND l.i1 = c.i1 JOIN g w ON w.i0 = c.i0 AND w.i1 = c.west JOIN g e ON e.i0 = c.i0 AND e.i1 = c.east""")
def stencil_2d_cyclic(spark, d):
    return _rounded(stencil.apply(grid(spark, d), _STAR, (stencil.CYCLIC, stencil.CYCLIC), 3.0))


@query(f"""WITH {_GRID} SELECT c.i0, c.i1, round(3 * c.value + 0.5 * coalesce(u.value, (c.i0 - 1) + c.i1 * 0.5) + 0.25 * coalesce(l.value, (c.i0 + 1) + c.i1 * 0.5)
       + 2 * coalesce(w.value, c.i0 + (c.i1 - 1) * 0.5) + coalesce(e.value, c.i0 + (c.i1 + 1) * 0.5), 6) AS value FROM g c
       LEFT JOIN g u ON u.i0 = c.i0 - 1 AND u.i1 = c.i1 LEFT JOIN g l ON l.i0 = c.i0 + 1 AND l.i1 = c.i1 LEFT JOIN g w ON w.i0 = c.i0 AND w.i1 = c.i1 - 1 LEFT JOIN g e ON e.i0 = c.i0 AND e.i1 = c.i1 + 1""")
def stencil_2d_custom(spark, d):
    return _rounded(stencil.apply(grid(spark, d), _STAR, (stencil.CUSTOM, stencil.CUSTOM), 3.0, lambda c: c[0] + c[1] * 0.5))


@query(f"""WITH {_GRID} SELECT c.i0, c.i1, round(CASE WHEN u.value IS NULL OR l.value IS NULL OR w.value IS NULL OR e.value IS NULL THEN c.value
       ELSE 0.40 * c.value + 0.15 * (u.value + l.value + w.value + e.value) END, 6) AS value FROM g c
       LEFT JOIN g u ON u.i0 = c.i0 - 1 AND u.i1 = c.i1 LEFT JOIN g l ON l.i0 = c.i0 + 1 AND l.i1 = c.i1 LEFT JOIN g w ON w.i0 = c.i0 AND w.i1 = c.i1 - 1 LEFT JOIN g e ON e.i0 = c.i0 AND e.i1 = c.i1 + 1""")
def stencil_blur(spark, d):
    return _rounded(stencil.blur(grid(spark, d)))


@query(f"""WITH {_GRID} SELECT c.i0, c.i1, max(n.value) AS value FROM g c JOIN g n ON n.i0 BETWEEN c.i0 - 1 AND c.i0 + 1 AND n.i1 BETWEEN c.i1 - 1 AND c.i1 + 1
       GROUP BY 1, 2 HAVING count(*) = 9""")
def stencil_max_filter(spark, d):
    out = stencil.folded(grid(spark, d), stencil.StencilSpec.full(2), (stencil.NONE, stencil.NONE), MAX)
    return out.df.select("i0", "i1", "value")


_HEAT = """SELECT c.i0, c.i1, c.value + 0.1 * (u.value + l.value - 2 * c.value) + 0.1 * (w.value + e.value - 2 * c.value) AS value FROM wrapped_{g} c
       JOIN {g} u ON u.i0 = c.up AND u.i1 = c.i1 JOIN {g} l ON l.i0 = c.down AND l.i1 = c.i1 JOIN {g} w ON w.i0 = c.i0 AND w.i1 = c.west JOIN {g} e ON e.i0 = c.i0 AND e.i1 = c.east"""


@query(f"WITH {_GRID}, {_WRAPPED.format(g='g')}, h AS MATERIALIZED ({_HEAT.format(g='g')}), {_WRAPPED.format(g='h')}, k AS ({_HEAT.format(g='h')}) SELECT i0, i1, round(value, 6) AS value FROM k")
def heat_steps(spark, d):
    return _rounded(stencil.heat(grid(spark, d), 2))


@query(f"WITH {_GRID} SELECT round(sum(value), 4) AS energy FROM g")
def heat_energy(spark, d):
    return alg.reduce(stencil.heat(grid(spark, d), 2), PLUS).select(F.round("value", 4).alias("energy"))


def _rounded(a: GridArray) -> DataFrame:
    return a.df.select("i0", "i1", F.round("value", 6).alias("value"))


# linear algebra


@query(f"WITH {_GRID} SELECT a.i1 AS i0, b.i1, round(sum(a.value * b.value), 6) AS value FROM g a JOIN g b USING (i0) GROUP BY 1, 2")
def matmul_gram(spark, d):
    g = grid(spark, d)
    return _rounded(linalg.matmul(linalg.transpose(g), g))


@query("""WITH a AS (SELECT c_nationkey AS i0, c_custkey AS k, c_acctbal AS x FROM customer), b AS (SELECT o_custkey AS k, o_orderkey % 10 AS i1, o_totalprice AS y FROM orders)
       SELECT i0::BIGINT AS i0, i1, round(sum(x * y) / 1e6, 3) AS value FROM a JOIN b USING (k) GROUP BY 1, 2""")
def matmul_sparse(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = c.count()
    a = GridArray(c.select(F.col("c_nationkey").cast("long").alias("i0"), F.col("c_custkey").alias("i1"), F.col("c_acctbal").alias("value")), Pattern.of((25, n)))
    b = GridArray(o.select(F.col("o_custkey").alias("i0"), F.pmod("o_orderkey", long(10)).alias("i1"), F.col("o_totalprice").alias("value")), Pattern.of((n, 10)))
    return linalg.matmul_sparse(a, b).df.select("i0", "i1", F.round(F.col("value") / 1e6, 3).alias("value"))


# collectives, coarrays


def _coarray(spark: SparkSession, d: str) -> DataFrame:
    """Orders over eight images."""
    return table(spark, d, "orders").select(F.pmod("o_orderkey", long(8)).cast("int").alias("image"), F.expr("o_orderkey div 8").alias("i"), F.col("o_custkey").alias("value"))


@query("SELECT o_orderkey // 8 AS i, sum(o_custkey)::BIGINT AS value FROM orders GROUP BY 1")
def coarray_coreduce(spark, d):
    return keyed.coreduce(_coarray(spark, d), ["i"], PLUS)


@query("SELECT o_orderkey // 8 AS i, t.u::INTEGER AS image, o_custkey AS value FROM orders, range(8) t(u) WHERE o_orderkey % 8 = 2")
def coarray_cobroadcast(spark, d):
    return keyed.cobroadcast(_coarray(spark, d), 2, 8)


@query("SELECT o_orderkey AS gidx, t.u::INTEGER AS unit, o_custkey AS value FROM orders, range(3) t(u)")
def scatter_allgather(spark, d):
    a = orders(spark, d, "o_custkey")
    return collectives.allgather(collectives.scatter(a.df, 128), 128, 3).select("gidx", "unit", "value")


@query("SELECT (o_orderkey // 100)::INTEGER AS unit, list(o_custkey ORDER BY o_orderkey)[1:5]::VARCHAR AS first_five, count(*) AS n FROM orders GROUP BY 1")
def gather_lists(spark, d):
    lists = collectives.gather_lists(collectives.scatter(orders(spark, d, "o_custkey").df, 100))
    five = F.concat(F.lit("["), F.array_join(arrays.take(F.col("values"), 5).cast("array<string>"), ", "), F.lit("]"))
    return lists.select("unit", five.alias("first_five"), F.size("values").cast("long").alias("n"))


@query("SELECT o_orderkey // 8 AS unit, (o_orderkey % 8)::INTEGER AS slot, o_custkey AS value FROM orders")
def alltoall_transpose(spark, d):
    return collectives.alltoall(_coarray(spark, d).select(F.col("image").alias("unit"), F.col("i").alias("slot"), "value"))


@query("SELECT ((n_nationkey % 5 + 1) % 5)::INTEGER AS unit, n_nationkey::BIGINT AS value FROM nation")
def sendrecv_ring(spark, d):
    df = table(spark, d, "nation").select(F.pmod("n_nationkey", F.lit(5)).alias("unit"), F.col("n_nationkey").cast("long").alias("value"))
    return collectives.sendrecv(df, 5)


@query("SELECT n_name AS child, r_name AS team FROM nation JOIN region ON r_regionkey = n_nationkey % 5 WHERE n_nationkey % 5 IN (1, 3)")
def team_members(spark, d):
    nation = table(spark, d, "nation")
    a = GridArray(nation.select(F.col("n_nationkey").cast("long").alias("gidx"), F.col("n_name").alias("value")), Pattern.of((nation.count(),), (CYCLIC,), 5))
    named = views.of_team(a, (1, 3)).select(F.col("value").alias("child"), F.col("unit").alias("r_regionkey"))
    return named.join(table(spark, d, "region"), "r_regionkey").select("child", F.col("r_name").alias("team"))


# maps, lists, counters, atomics


def _inserts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("value").alias("mapped"), F.col("event_id").alias("seq"))


@query("SELECT user_id AS key, arg_min(value, event_id) AS mapped FROM events GROUP BY 1")
def map_insert_first_wins(spark, d):
    return keyed.insert_first_wins(_inserts(spark, d))


@query("SELECT event_id AS seq, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS inserted FROM events")
def map_insert_flags(spark, d):
    return keyed.insert_flags(_inserts(spark, d)).select("seq", "key", "inserted")


@query("SELECT c_custkey AS key, m IS NOT NULL AS found, coalesce(m, -1.0)::DOUBLE AS mapped FROM customer LEFT JOIN (SELECT user_id, arg_min(value, event_id) AS m FROM events GROUP BY 1) ON user_id = c_custkey")
def map_lookup(spark, d):
    return keyed.lookup(keyed.insert_first_wins(_inserts(spark, d)), table(spark, d, "customer").select(F.col("c_custkey").alias("key")), F.lit(-1.0))


@query("SELECT (k % 6)::INTEGER AS unit, count(*) AS n FROM (SELECT DISTINCT user_id AS k FROM events) GROUP BY 1")
def map_bucket_sizes(spark, d):
    m = keyed.insert_first_wins(_inserts(spark, d)).withColumn("unit", F.pmod("key", long(6)).cast("int"))
    return keyed.bucket_sizes(m)


@query("SELECT unit::INTEGER AS unit, (row_number() OVER (PARTITION BY unit ORDER BY part, seq) - 1)::BIGINT AS lseq, value FROM (SELECT user_id % 4 AS unit, event_id >= 500 AS part, event_id AS seq, value FROM events)")
def list_push_back(spark, d):
    df = table(spark, d, "events").select(F.pmod("user_id", long(4)).cast("int").alias("unit"), F.col("event_id").alias("seq"), "value")
    empty = spark.createDataFrame([], "unit int, lseq long, value double")
    first = keyed.push_back(empty, df.where("seq < 500"))
    return keyed.push_back(first, df.where("seq >= 500"))


@query("SELECT count(*)::BIGINT AS value FROM events")
def counter_total(spark, d):
    per_unit = table(spark, d, "events").groupBy(F.pmod("user_id", long(8)).alias("unit")).agg(F.count("*").alias("value"))
    return keyed.counter_get(per_unit)


@query("SELECT user_id AS gidx, event_id AS seq, coalesce(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fetched FROM events")
def atomic_fetch_add(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("gidx"), F.col("event_id").alias("seq"), F.length("event_type").cast("long").alias("value"))
    return keyed.fetch_add(u).select("gidx", "seq", "fetched")


@query("SELECT user_id AS gidx, event_id AS seq, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS fetched FROM events")
def atomic_exchange(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("gidx"), F.col("event_id").alias("seq"), "value")
    return keyed.exchange(u).select("gidx", "seq", "fetched")


@query("SELECT user_id AS gidx, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def atomic_store(spark, d):
    return keyed.store_last(table(spark, d, "events").select(F.col("user_id").alias("gidx"), F.col("event_id").alias("seq"), "value"))


@query("""SELECT o_orderkey AS gidx, xor(o_custkey, coalesce(x, 0))::BIGINT AS value FROM orders LEFT JOIN (
       SELECT (l_partkey * 31 + l_suppkey) % (SELECT count(*) FROM orders) AS g, bit_xor(l_partkey) AS x FROM lineitem GROUP BY 1) ON g = o_orderkey""")
def random_access_xor(spark, d):
    a = orders(spark, d, "o_custkey")
    updates = table(spark, d, "lineitem").select(F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey"), long(a.size)).alias("gidx"), F.col("l_partkey").alias("value"))
    return alg.accumulate(a, updates, BIT_XOR).df


# array expressions


@query("""SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS dot, len(embedding[1:5]) AS taken,
       len(embedding[6:]) AS dropped, round(embedding[1]::DOUBLE, 6) AS head, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 5) AS total, 3::BIGINT AS replaced FROM embeddings""")
def array_expressions(spark, d):
    e = F.col("embedding").cast("array<double>")
    a = table(spark, d, "embeddings")
    total = arrays.accumulate(arrays.transform(e, lambda x: x * 2), F.lit(0.0), lambda s, x: s + x)
    return a.select(
        "vec_id", F.round(arrays.inner_product(e, arrays.reverse(e), F.lit(0.0)), 6).alias("dot"), F.size(arrays.take(e, 5)).cast("long").alias("taken"), F.size(arrays.drop(e, 5)).cast("long").alias("dropped"),
        F.round(arrays.head(e), 6).alias("head"), F.round(total, 5).alias("total"), F.element_at(arrays.replace_nth(e, 3, F.lit(3.0)), 4).cast("long").alias("replaced"),
    )


@query("SELECT o_orderkey AS gidx, (o_custkey + 6) // 7 AS value FROM orders")
def math_div_ceil(spark, d):
    return alg.for_each(orders(spark, d, "o_custkey"), lambda v: arrays.div_ceil(v, long(7))).df


# extensions


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    out = windowed_reduce(table(spark, d, "events"), "ts", "value", "1 hour", "10 minutes", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


from tessera import queries_grid, queries_store, queries_units  # noqa: E402  their queries join the register

__all__ = ["ORACLE_SQL", "QUERIES", "queries_grid", "queries_store", "queries_units"]
