"""Collective operations between units, as joins and regroupings on a unit column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.patterns import div, long, mod


def broadcast(df: DataFrame, units: int) -> DataFrame:
    """Every unit with all rows."""
    return df.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))


def scatter(df: DataFrame, each: int) -> DataFrame:
    """Rows of one unit dealt to all: ``each`` consecutive ones to a unit."""
    return df.withColumn("unit", div(F.col("gidx"), each).cast("int")).withColumn("lidx", mod(F.col("gidx"), each))


def gather(df: DataFrame, each: int) -> DataFrame:
    """The inverse of ``scatter``: (unit, lidx, value) to gidx."""
    return df.select((F.col("unit") * long(each) + F.col("lidx")).alias("gidx"), "value")


def gather_lists(df: DataFrame) -> DataFrame:
    """Each unit's values as one array in the order of their places; a unit's part must fit into one row."""
    rows = F.array_sort(F.collect_list(F.struct("lidx", "value")))
    return df.groupBy("unit").agg(F.transform(rows, lambda r: r["value"]).alias("values"))


def allgather(df: DataFrame, each: int, units: int) -> DataFrame:
    return broadcast(gather(df, each), units)


def gatherv(df: DataFrame) -> DataFrame:
    """(unit, lidx, value) to gidx where units have parts of any size: each after those of the units before it."""
    sizes = df.groupBy("unit").agg(F.count("*").alias("_n"))  # a row for each unit
    before = F.sum("_n").over(Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("unit", F.coalesce(before, F.lit(0)).alias("_start"))
    return df.join(F.broadcast(starts), "unit").select((F.col("_start") + F.col("lidx")).alias("gidx"), "value")


def allgatherv(df: DataFrame, units: int) -> DataFrame:
    return broadcast(gatherv(df), units)


def alltoall(df: DataFrame) -> DataFrame:
    """(unit, slot, value) with unit and slot exchanged."""
    return df.select(F.col("slot").alias("unit"), F.col("unit").alias("slot"), "value")


def sendrecv(df: DataFrame, units: int, by: int = 1) -> DataFrame:
    """Each unit's rows sent to the unit ``by`` places on, around the ring."""
    return df.withColumn("unit", F.pmod(F.col("unit") + by, F.lit(units)).cast("int"))


def max_location(df: DataFrame) -> DataFrame:
    """The largest value and the smallest unit that has it."""
    return df.agg(F.max(F.struct("value", (-F.col("unit")).alias("u"))).alias("m")).select(F.col("m.value").alias("value"), (-F.col("m.u")).alias("unit"))
