"""Queries of sources and sinks: arrays allocated, stored and read again, and text formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.catalogue import GRID, grid, orders, query
from tessera.operators.array import GridArray
from tessera.plans.patterns import BLOCKCYCLIC, BLOCKED, CYCLIC, TILE, Pattern, TilePattern, long, unit_map
from tessera.session import shared_folder, table
from tessera.sources import storage


def _path(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"


@query("SELECT gidx, (gidx // 5 % 3)::INTEGER AS unit, 7.5::DOUBLE AS value FROM range(1000) t(gidx)")
def allocate_array(spark, d):
    return GridArray.allocate(spark, Pattern.of((1000,), (BLOCKCYCLIC(5),), 3), F.lit(7.5)).placed().select("gidx", "unit", "value")


@query("SELECT i0, i1, (i0 % 2 * 2 + i1 // 15)::INTEGER AS unit, NULL::DOUBLE AS value FROM range(20) a(i0), range(30) b(i1)")
def allocate_matrix(spark, d):
    return GridArray.allocate(spark, Pattern.of((20, 30), (CYCLIC, BLOCKED), team=(2, 2))).placed().select("i0", "i1", "unit", "value")


@query("SELECT i - 1 AS gidx, [3, 1, 4, 1, 5][i]::BIGINT AS value FROM range(1, 6) t(i)")
def initializer_list(spark, d):
    return GridArray.from_values(spark, [3, 1, 4, 1, 5], "long").df


@query("SELECT o_orderkey AS gidx, ((o_orderkey // 16) % 6)::INTEGER AS unit, o_orderkey // 96 * 16 + o_orderkey % 16 AS lidx, o_totalprice AS value FROM orders")
def stored_array(spark, d):
    """Written and read again; the pattern comes back with the values."""
    store = storage.ArrayStore(spark, _path(spark))
    store.dataset("prices/all") << orders(spark, d, pattern=lambda n: Pattern.of((n,), (BLOCKCYCLIC(16),), 6))
    return store.dataset("prices/all").read().placed().select("gidx", "unit", F.col("lidx").cast("long").alias("lidx"), "value")


@query(f"WITH {GRID} SELECT i0, i1, (i0 // 10 * 8 + i1 // 8)::BIGINT AS block, value FROM g")
def stored_matrix_by_block(spark, d):
    """Files in the order of blocks, so that a block is read alone."""
    g = grid(spark, d)
    store = storage.ArrayStore(spark, _path(spark)).by_block()
    store << GridArray(g.df, TilePattern.of(g.pattern.extents, (TILE(10), TILE(8)), team=(2, 3)))
    return (store >> None).placed().select("i0", "i1", "block", "value")


@query("SELECT o_orderkey AS gidx, CASE WHEN o_orderkey % 10 = 3 THEN -1.0 ELSE o_totalprice END::DOUBLE AS value FROM orders UNION ALL SELECT count(*), 5.0 FROM orders")
def stored_modified(spark, d):
    """A stored array of which some cells are replaced, and then one is added; the writes wait until they are asked for."""
    a = orders(spark, d)
    store = storage.ArrayStore(spark, _path(spark)).later()
    store << a
    store.modify() << a.with_df(a.df.where(F.pmod("gidx", long(10)) == 3).withColumn("value", F.lit(-1.0)))
    store.mode("append") << a.with_df(spark.createDataFrame([(a.size, 5.0)], "gidx long, value double"))
    store.flush()
    return store.read(Pattern.of((a.size + 1,))).df


@query("SELECT o_orderkey AS gidx, round(round(o_totalprice * 100) / 100, 2) AS value FROM orders")
def stored_converted(spark, d):
    """Prices kept as whole cents, the pattern under a name of its own."""
    store = storage.ArrayStore(spark, _path(spark)).pattern_key("layout")
    store.converter(lambda v: F.round(v * 100).cast("long")) << orders(spark, d)
    return store.converter(lambda v: F.round(v / 100, 2)).read().df


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 50 AS b FROM orders WHERE o_custkey <> o_orderkey % 50)
       SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e""")
def matrix_market(spark, d):
    """The graph of customers and orders' last digits, written as a coordinate file and read again."""
    edges = table(spark, d, "orders").select(F.concat_ws(" ", F.col("o_custkey") + 1, F.pmod("o_orderkey", long(50)) + 1).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate pattern symmetric",), ("100 100 100",)], "value string").coalesce(1)
    path = _path(spark)
    head.unionByName(edges).coalesce(1).write.text(path)  # the format is one file, its size line first
    return storage.read_matrix_market(spark, path)


@query("SELECT n_nationkey::BIGINT AS src, (n_nationkey * 7 + k) % 25 AS dst FROM nation, range(3) t(k)")
def adjacency_rows(spark, d):
    """Three edges of each nation, written as compressed sparse rows and read again."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    near = n.select("i", F.concat_ws(" ", *(F.pmod(F.col("i") * 7 + k, long(25)) for k in range(3))).alias("line"))
    lines = near.agg(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.count("*")), lambda r: r * 3)).alias("starts"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))
    text = lines.select(F.explode(F.concat(F.array("starts"), F.transform("rows", lambda r: r["line"]))).alias("value"))
    path = _path(spark)
    text.coalesce(1).write.text(path)
    return storage.read_adjacency(spark, path)


@query(f"""WITH {GRID}, p AS (SELECT i0, string_agg(greatest(0, least(255, round(abs(value) * 1000)))::INTEGER::VARCHAR, ' ' ORDER BY i1) AS t FROM g GROUP BY 1)
       SELECT i0 + 3 AS line, t AS text FROM p UNION ALL SELECT 0, 'P2' UNION ALL SELECT 1, '64 ' || count(*) FROM embeddings UNION ALL SELECT 2, '255'""")
def pgm_image(spark, d):
    g = grid(spark, d)
    return storage.pgm_lines(g.with_df(g.df.withColumn("value", F.abs("value") * 1000)))


@query("SELECT i0 AS line, string_agg((i0 // 5 % 2 * 2 + i1 // 4 % 2)::VARCHAR, ' ' ORDER BY i1) AS text FROM range(20) a(i0), range(18) b(i1) GROUP BY 1")
def pattern_unit_map(spark, d):
    return unit_map(spark, TilePattern.of((20, 18), (TILE(5), TILE(4)), team=(2, 2)))


@query("SELECT 0::BIGINT AS left_behind, true AS removed")
def deallocate_array(spark, d):
    """A stored array given back."""
    store = storage.ArrayStore(spark, _path(spark))
    a = orders(spark, d)
    a.deallocate()
    removed = (store << a).remove()
    return spark.createDataFrame([(int(store.remove()), removed)], "left_behind long, removed boolean")
