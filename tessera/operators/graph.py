"""Graphs as tables of edges (src, dst)."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once; loops go."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


#: Graphs of no more edges are brought to the driver to be ordered; larger ones are worked on as tables.
MOST_EDGES = 1_000_000


def minimum_degree_order(edges: DataFrame, every: int = 8, most: int = MOST_EDGES) -> DataFrame:
    """step, node, degree: the order of elimination of a symmetric graph by least degree, ties to the smaller node.

    Each step takes the node of least degree and joins its neighbours to one another. A step depends on the one before,
    so a graph whose edges fit on the driver is ordered there; beyond ``most`` edges each step is a query on tables,
    with the same result."""
    spark = edges.sparkSession
    left = checkpointed(symmetric(edges))
    nodes = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    if left.limit(most + 1).count() <= most and nodes.limit(most + 1).count() <= most:
        found = _order([r[0] for r in nodes.collect()], [tuple(r) for r in left.collect()])
    else:
        found = _order_of_tables(left, nodes, every)
    return spark.createDataFrame(found, "step long, node long, degree long")


def _order(nodes: list[int], edges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
    ahead = [(len(others), n) for n, others in near.items()]
    heapify(ahead)
    out: list[tuple[int, int, int]] = []
    while ahead:
        degree, node = heappop(ahead)
        if node not in near or degree != len(near[node]):
            continue  # entered anew since
        out.append((len(out), node, degree))
        around = near.pop(node)
        for n in around:
            near[n] |= around
            near[n] -= {n, node}
            heappush(ahead, (len(near[n]), n))
    return out


def _order_of_tables(left: DataFrame, nodes: DataFrame, every: int) -> list[tuple[int, int, int]]:
    n, out = nodes.count(), []
    while len(out) < n:
        known = nodes.join(degrees(left).withColumnRenamed("src", "node"), "node", "left")
        degree = F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
        pick = known.agg(F.min(F.struct(degree, "node")).alias("m")).first()["m"]
        out.append((len(out), pick["node"], pick["degree"]))
        nodes = nodes.where(F.col("node") != pick["node"])
        reach = left.where(F.col("src") == pick["node"]).select(F.col("dst").alias("node"), F.lit(1).alias("_k"))
        clique = reach.select(F.col("node").alias("src"), "_k").join(reach.select(F.col("node").alias("dst"), "_k"), "_k").where("src <> dst").drop("_k")
        rest = left.where((F.col("src") != pick["node"]) & (F.col("dst") != pick["node"])).unionByName(clique).distinct()
        if len(out) % every == 0:
            rest, nodes = checkpointed(rest), checkpointed(nodes)
        left = rest
    return out
