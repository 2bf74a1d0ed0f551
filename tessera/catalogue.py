"""The register of queries, and the driver's tables as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.array import GridArray, matrix_of_arrays
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def orders(spark: SparkSession, d: str, value: str = "o_totalprice", pattern: Callable[[int], object] | None = None) -> GridArray:
    """Orders as an array over the dense key; the extent is the number of rows."""
    df = table(spark, d, "orders")
    n = df.count()
    return GridArray.of(df, "o_orderkey", value, n, pattern(n) if pattern else None)


def events(spark: SparkSession, d: str) -> GridArray:
    df = table(spark, d, "events")
    return GridArray.of(df, "event_id", "value", df.count())


def grid(spark: SparkSession, d: str) -> GridArray:
    df = table(spark, d, "embeddings")
    return matrix_of_arrays(df.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id", "e", (df.count(), 64))


#: SQL of ``grid``.
GRID = "g AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding)::DOUBLE AS value FROM embeddings)"
