"""Dense arrays as DataFrames.

An array of one dimension has the columns (gidx, value), one of n dimensions (i0, .., i<n-1>, value). Each index
occurs once; a null value is a cell that was not set. Views keep the original index and add one of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.patterns import IrregularPattern, Pattern, coords_of, long


@dataclass(frozen=True)
class GridArray:
    df: DataFrame
    pattern: Pattern | IrregularPattern
    origin: GridArray | None = None
    made: Callable[[GridArray], GridArray] | None = field(default=None, compare=False)  # how a view comes from its origin

    @classmethod
    def of(cls, df: DataFrame, index: str, value: str | Column, extent: int, pattern: Pattern | IrregularPattern | None = None) -> GridArray:
        """A table with a dense key as an array."""
        v = F.col(value) if isinstance(value, str) else value
        return cls(df.select(F.col(index).cast("long").alias("gidx"), v.alias("value")), pattern or Pattern.of((extent,)))

    @classmethod
    def allocate(cls, spark: SparkSession, pattern: Pattern | IrregularPattern, value: Column | None = None) -> GridArray:
        """A new array with one value in all cells (unset if none is given)."""
        value = F.lit(None).cast("double") if value is None else value
        base = spark.range(pattern.size).withColumnRenamed("id", "gidx")
        if len(pattern.extents) == 1:
            return cls(base.select("gidx", value.alias("value")), pattern)
        coords = pattern.coords(F.col("gidx"))
        return cls(base.select(*(c.alias(f"i{d}") for d, c in enumerate(coords)), value.alias("value")), pattern)

    @classmethod
    def from_values(cls, spark: SparkSession, values: list, kind: str, pattern: Pattern | None = None) -> GridArray:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"gidx long, value {kind}")
        return cls(df, pattern or Pattern.of((len(values),)))

    @property
    def ndim(self) -> int:
        return len(self.pattern.extents)

    @property
    def size(self) -> int:
        return math.prod(self.pattern.extents)

    @property
    def coords(self) -> list[Column]:
        return [F.col("gidx")] if self.ndim == 1 else [F.col(f"i{d}") for d in range(self.ndim)]

    @property
    def index_names(self) -> list[str]:
        return ["gidx"] if self.ndim == 1 else [f"i{d}" for d in range(self.ndim)]

    def deallocate(self) -> None:
        """Gives back what Spark holds of the array; it is made again where it is used again."""
        self.df.unpersist()

    def with_df(self, df: DataFrame) -> GridArray:
        return replace(self, df=df)

    def gidx(self) -> Column:
        return self.pattern.linear(self.coords)

    def at(self, *place: int) -> DataFrame:
        """The cell at a place; beyond the extents an IndexError."""
        if len(place) != self.ndim or any(not 0 <= p < e for p, e in zip(place, self.pattern.extents)):
            raise IndexError(f"{place} is outside {self.pattern.extents}")
        return self[place if self.ndim > 1 else place[0]]

    def __getitem__(self, place: int | tuple[int, ...]) -> DataFrame:
        """The cell at a place, no row where there is none; the filter reaches the scan."""
        place = place if isinstance(place, tuple) else (place,)
        out = self.df
        for c, p in zip(self.coords, place):
            out = out.where(c == p)
        return out

    def element(self, gidx: int) -> DataFrame:
        """The cell at a linear place, the linear place being turned into coordinates on the driver."""
        if self.ndim == 1:
            return self[gidx]
        at, rest = [], gidx
        sizes = self.pattern.extents if self.pattern.order == "row" else tuple(reversed(self.pattern.extents))
        for e in reversed(sizes[1:]):
            at.append(rest % e)
            rest //= e
        at.append(rest)
        return self[tuple(reversed(at)) if self.pattern.order == "row" else tuple(at)]

    def placed(self) -> DataFrame:
        """The cells with their unit, block and place within the unit."""
        return self.df.select("*", self.pattern.unit_at(self.coords).alias("unit"), self.pattern.block_at(self.coords).cast("long").alias("block"), self.pattern.local_index(self.coords).alias("lidx"))

    def swap(self, a: int, b: int) -> GridArray:
        """Two cells of a one-dimensional array exchanged, by exchanging their indices."""
        g = F.col("gidx")
        return self.with_df(self.df.withColumn("gidx", F.when(g == a, long(b)).when(g == b, long(a)).otherwise(g)))

    def member(self, name: str) -> GridArray:
        """The array of one field of struct values."""
        return self.with_df(self.df.withColumn("value", F.col(f"value.{name}")))

    def to_matrix(self, extents: tuple[int, ...], order: str = "row") -> GridArray:
        """A one-dimensional array read as one of more dimensions."""
        coords = coords_of(F.col("gidx"), extents, order)
        return GridArray(self.df.select(*(c.alias(f"i{d}") for d, c in enumerate(coords)), "value"), Pattern.of(extents, order=order))

    def flat(self) -> GridArray:
        """An array of more dimensions read in its linear order."""
        return GridArray(self.df.select(self.gidx().alias("gidx"), "value"), Pattern.of((self.size,)))


def matrix_of_arrays(df: DataFrame, index: str, array: str, extents: tuple[int, int]) -> GridArray:
    """A column of equally long arrays as a matrix (row: index, column: place in the array)."""
    rows = df.select(F.col(index).cast("long").alias("i0"), F.posexplode(array).alias("i1", "value"))
    return GridArray(rows.select("i0", F.col("i1").cast("long").alias("i1"), "value"), Pattern.of(extents))
