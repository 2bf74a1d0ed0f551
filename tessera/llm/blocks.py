"""Searches of a stated set of queries against all vectors, in blocks.

Vectors are packed into blocks of a bounded number of rows, queries likewise. Each pair of a block and a block of
queries is one row of the pair table, a task works on a few pairs, and gives each query's best rows of the block.
What is shuffled is the packed blocks, once for each block of queries; nothing is broadcast or collected.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, vector as doubles, dim) of the rows that take part: no null or non-finite component, not empty; zero vectors if wanted."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(finite, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size(v))


def packed(rows: DataFrame, most: int, pack: Callable[[np.ndarray, np.ndarray], bytes], n_rows: int) -> DataFrame:
    """(dim, block, n, payload): blocks of at most ``most`` rows of one dimension, cut from the partitions as they are read.

    A block's number tells its partition and place there, so a task that runs again gives the same blocks."""
    if n_rows:
        rows = rows.coalesce(max(1, -(-n_rows // most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        first, made = TaskContext.get().partitionId() << 32, itertools.count()

        def out(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dim]])
            matrix = np.concatenate([m for _, m in held[dim]])
            held[dim] = []
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([first + next(made)], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([pack(ids, matrix)], pa.binary())],
                ["dim", "block", "n", "payload"],
            )

        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            flat = batch.column("vector").flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                matrix = flat[starts[at][:, None] + np.arange(dim)]
                own = held.setdefault(int(dim), [])
                while len(at):
                    room = most - sum(len(i) for i, _ in own)
                    own.append((ids[at[:room]], matrix[:room]))
                    at, matrix = at[room:], matrix[room:]
                    if sum(len(i) for i, _ in own) >= most:
                        yield out(int(dim))
                        own = held[int(dim)]
        for dim in list(held):
            if held[dim]:
                yield out(dim)

    return rows.select("id", "vector", "dim").mapInArrow(run, "dim int, block long, n int, payload binary")


def rows_of(n_rows: int, most: int, least: int = 1024, parts: int = 12) -> int:
    """Rows of a block. What is shuffled is each block once for each block of the other side, so blocks are as large as
    memory allows; ``most`` is that bound. Smaller tables are cut into ``parts``, so that several tasks have work, but
    not into blocks of fewer than ``least`` rows."""
    return min(most, max(least, -(-n_rows // parts)))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """The stated set of queries: rows whose id is divisible by ``every``, one for each id."""
    return rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with their places 0, 1, ... among the blocks of their dimension; only keys of blocks are sorted for that."""
    keys = blocks.select("dim", "block").withColumn("no", F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1)
    return blocks.join(keys, ["dim", "block"])


def search(index: DataFrame, queries: DataFrame, best: Callable[[bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of highest score over all blocks, ties to the smaller id.

    ``best`` gives (query ids, row ids, scores) of one pair of blocks, each query's ``k`` best at least.
    ``index`` and ``queries`` are tables of blocks; a pair of blocks is one group, so a task holds one pair at a time."""
    left, right = _numbered(index.select("dim", "block", "payload")), _numbered(queries.select("dim", "block", F.col("payload").alias("wanted")))
    n_left = left.groupBy("dim").agg(F.count("*").alias("blocks"))  # as many rows as there are dimensions
    n_right = right.groupBy("dim").agg(F.count("*").alias("blocks"))
    left = left.join(F.broadcast(n_right), "dim").withColumn("qno", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = right.withColumnRenamed("no", "qno").join(F.broadcast(n_left), "dim").withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = left.select("dim", F.col("no").cast("long").alias("no"), "qno", "payload").join(right.select("dim", "no", F.col("qno").cast("long").alias("qno"), "wanted"), ["dim", "no", "qno"])
    kind = pa.int64() if score == "long" else pa.float64()

    def run(group: pa.Table) -> pa.Table:
        parts = [best(group.column("payload")[i].as_buffer(), group.column("wanted")[i].as_buffer()) for i in range(group.num_rows)]
        ids, rows, scores = (np.concatenate(x) for x in zip(*parts))
        return pa.table([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(scores, kind)], ["query_id", "vec_id", "score"])

    found = pairs.groupBy("dim", "no", "qno").applyInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
