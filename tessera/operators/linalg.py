"""Linear algebra on matrices of (i0, i1, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.array import GridArray
from tessera.plans.patterns import Pattern, div_ceil


def _checked(a: GridArray, b: GridArray) -> Pattern:
    if a.ndim != 2 or b.ndim != 2 or a.pattern.extents[1] != b.pattern.extents[0]:
        raise ValueError(f"extents {a.pattern.extents} and {b.pattern.extents} don't fit")
    return Pattern.of((a.pattern.extents[0], b.pattern.extents[1]))


def matmul_sparse(a: GridArray, b: GridArray) -> GridArray:
    """The product of matrices of few cells each row: a join on the inner index and one sum."""
    pattern = _checked(a, b)
    left = a.df.select(F.col("i0"), F.col("i1").alias("k"), F.col("value").alias("x"))
    right = b.df.select(F.col("i0").alias("k"), F.col("i1"), F.col("value").alias("y"))
    return GridArray(left.join(right, "k").groupBy("i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("value")), pattern)


def _tiles(a: GridArray, rows: int, cols: int, names: tuple[str, str]) -> DataFrame:
    """One row for each tile: its numbers and its cells as one array of (place, value)."""
    r, c = F.expr(f"i0 div {rows}"), F.expr(f"i1 div {cols}")
    cells = a.df.select(r.alias(names[0]), c.alias(names[1]), (F.col("i0") % rows * cols + F.col("i1") % cols).cast("int").alias("p"), F.col("value").cast("double").alias("v"))
    return cells.where("v IS NOT NULL").groupBy(*names).agg(F.collect_list("p").alias("p"), F.collect_list("v").alias("v"))


def matmul(a: GridArray, b: GridArray, tile: int = 256) -> GridArray:
    """The product of dense matrices, tile by tile: tiles that meet are multiplied by BLAS, then summed.

    A tile has at most tile*tile cells, so memory is bounded; partial products are one row each."""
    pattern = _checked(a, b)
    pairs = _tiles(a, tile, tile, ("bi", "bk")).join(_tiles(b, tile, tile, ("bk", "bj")).withColumnsRenamed({"p": "q", "v": "w"}), "bk")
    n_rows, n_cols = pattern.extents

    def run(group: pa.Table) -> pa.Table:
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        out = np.zeros((tile, tile))
        for i in range(group.num_rows):
            x, y = np.zeros(tile * tile), np.zeros(tile * tile)
            x[group.column("p")[i].values.to_numpy()] = group.column("v")[i].values.to_numpy()
            y[group.column("q")[i].values.to_numpy()] = group.column("w")[i].values.to_numpy()
            out += x.reshape(tile, tile) @ y.reshape(tile, tile)
        out = out[: min(tile, n_rows - bi * tile), : min(tile, n_cols - bj * tile)]
        i, j = np.indices(out.shape)
        return pa.table([pa.array((i + bi * tile).ravel().astype(np.int64)), pa.array((j + bj * tile).ravel().astype(np.int64)), pa.array(out.ravel())], ["i0", "i1", "value"])

    # the inner tiles of one output tile are summed in portions, so that a group holds a bounded number of them
    portion = 64
    if div_ceil(a.pattern.extents[1], tile) <= portion:
        return GridArray(pairs.groupBy("bi", "bj").applyInArrow(run, "i0 long, i1 long, value double"), pattern)
    parts = pairs.withColumn("part", F.expr(f"bk div {portion}")).groupBy("bi", "bj", "part").applyInArrow(run, "i0 long, i1 long, value double")
    return GridArray(parts.groupBy("i0", "i1").agg(F.sum("value").alias("value")), pattern)


def transpose(a: GridArray) -> GridArray:
    return GridArray(a.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "value"), Pattern.of(tuple(reversed(a.pattern.extents))))
