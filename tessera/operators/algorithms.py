"""Algorithms on arrays: element-wise maps, searches, reductions, comparison and sorting.

Each takes arrays (or ranges of them, from `views.sub`) and returns an array or a DataFrame, lazily. A range leaves
the cells outside it untouched. Results don't depend on how Spark partitions the rows; ties go to the smaller index.
Nulls are cells that were not set: searches and reductions pass over them. NaN is larger than any number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.array import GridArray
from tessera.operators.reduce_ops import PLUS, ReduceOp
from tessera.plans.patterns import long
from tessera.session import checkpointed

Range = tuple[int, int] | None


def _inside(a: GridArray, where: Range) -> Column | None:
    if where is None:
        return None
    g = a.gidx()
    return (g >= where[0]) & (g < where[1])


def _cells(a: GridArray, where: Range) -> DataFrame:
    """gidx and value of the range."""
    df = a.df.select(a.gidx().alias("gidx"), "value")
    return df if where is None else df.where((F.col("gidx") >= where[0]) & (F.col("gidx") < where[1]))


def _update(a: GridArray, where: Range, value: Column) -> GridArray:
    inside = _inside(a, where)
    return a.with_df(a.df.withColumn("value", value if inside is None else F.when(inside, value).otherwise(F.col("value"))))


def fill(a: GridArray, value: Column, where: Range = None) -> GridArray:
    return _update(a, where, value)


#: The prime modulus and three multipliers of congruential generators.
MODULUS, MULTIPLIERS = (1 << 31) - 1, (48271, 69621, 16807)


def generate(a: GridArray, seed: int, where: Range = None) -> GridArray:
    """Numbers in [0, 1) that depend on index and seed alone, so every run and partitioning gives the same ones: three
    congruential rounds, the high bits folded onto the low ones between them."""
    x = F.pmod(a.gidx() + seed, long(MODULUS))
    for m in MULTIPLIERS:
        x = F.pmod((x.bitwiseXOR(F.shiftright(x, 13)) + 1) * long(m), long(MODULUS))
    return _update(a, where, x / float(MODULUS))


#: Types of one size and kind, between which values are converted unchanged.
KINDS = (("tinyint", "byte"), ("smallint", "short"), ("int", "integer"), ("bigint", "long"), ("float", "real"), ("double",))


def convertible(source: str, target: str) -> bool:
    """Whether values are copied between arrays of two types: the same one, or integers or floats of the same size."""
    return source == target or any(source in k and target in k for k in KINDS)


def converted(a: GridArray, kind: str) -> GridArray:
    """The array with values of another type; a TypeError where the types differ in size or kind."""
    own = a.df.schema["value"].dataType.simpleString()
    if not convertible(own, kind):
        raise TypeError(f"values of {own} are not copied to {kind}; cast them")
    return a.with_df(a.df.withColumn("value", F.col("value").cast(kind)))


def generate_with_index(a: GridArray, f: Callable[[Column], Column], where: Range = None) -> GridArray:
    return _update(a, where, f(a.gidx()))


def for_each(a: GridArray, f: Callable[[Column], Column], where: Range = None) -> GridArray:
    return _update(a, where, f(F.col("value")))


def for_each_with_index(a: GridArray, f: Callable[[Column, Column], Column], where: Range = None) -> GridArray:
    return _update(a, where, f(F.col("value"), a.gidx()))


def _aligned(a: GridArray, b: GridArray, shift: int, how: str) -> DataFrame:
    """gidx, a, b: the cells of two arrays side by side, those of b moved by ``shift``."""
    left = a.df.select(a.gidx().alias("gidx"), F.col("value").alias("a"))
    right = b.df.select((b.gidx() + shift).alias("gidx"), F.col("value").alias("b"))
    return left.join(right, "gidx", how)


def transform(a: GridArray, b: GridArray, op: ReduceOp | Callable[[Column, Column], Column]) -> GridArray:
    """op(a, b), cell by cell."""
    two = op.two if isinstance(op, ReduceOp) else op
    df = _aligned(a, b, 0, "inner").select("gidx", two(F.col("a"), F.col("b")).alias("value"))
    out = GridArray(df, a.pattern)
    return out if a.ndim == 1 else out.with_df(df.select(*(c.alias(n) for c, n in zip(a.pattern.coords(F.col("gidx")), a.index_names)), "value"))


def accumulate(target: GridArray, updates: DataFrame, op: ReduceOp = PLUS) -> GridArray:
    """target[i] = op(target[i], v) for all updates (gidx, value); they are combined by index before they are moved."""
    combined = updates.groupBy("gidx").agg(op.many(F.col("value"), F.col("gidx")).alias("update"))
    df = target.df.join(combined, "gidx", "left")
    return target.with_df(df.select("gidx", F.when(F.col("update").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("update")).otherwise(op.two(F.col("value"), F.col("update"))).alias("value")))


def copy(source: GridArray, target: GridArray, where: Range = None, at: int = 0) -> GridArray:
    """The cells of a range of ``source`` written to ``target`` from place ``at`` on; only the places written to are joined."""
    first, last = where or (0, source.size)
    moved = _cells(source, where).select((F.col("gidx") + (at - first)).alias("gidx"), F.struct("value").alias("new"))
    there = (F.col("gidx") >= at) & (F.col("gidx") < at + last - first)
    written = target.df.where(there).join(moved, "gidx", "left")
    written = written.select("gidx", F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("value")).alias("value"))
    return target.with_df(target.df.where(~there).select("gidx", "value").unionByName(written))


def gather(a: GridArray, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` and the value at its gidx; repeated indices stay, those outside give null."""
    return wanted.join(a.df.select("gidx", "value"), "gidx", "left")


def gather_strided(a: GridArray, first: int, stride: int) -> DataFrame:
    return a.df.where((F.col("gidx") >= first) & (F.pmod(F.col("gidx") - first, long(stride)) == 0))


def scatter(a: GridArray, updates: DataFrame, order: str | None = None) -> GridArray:
    """Cells overwritten by (gidx, value); of several for one index that of the largest ``order`` (or value) counts."""
    last = updates.groupBy("gidx").agg(F.max_by(F.struct("value"), F.col(order or "value")).alias("new"))
    df = a.df.join(last, "gidx", "left")
    return a.with_df(df.select("gidx", F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("value")).alias("value")))


def find(a: GridArray, value: Column, where: Range = None) -> DataFrame:
    """idx: the first index that holds the value, null if none does."""
    return find_if(a, lambda v: v == value, where)


def find_if(a: GridArray, p: Callable[[Column], Column], where: Range = None, order: str = "index") -> DataFrame:
    """idx of the first cell for which p holds: by index, or by unit and place within it."""
    cells = a.placed().select(a.gidx().alias("gidx"), "value", "unit", "lidx") if order == "unit" else _cells(a, where)
    if order == "unit":
        inside = F.lit(True) if where is None else (F.col("gidx") >= where[0]) & (F.col("gidx") < where[1])
        return cells.where(inside & p(F.col("value"))).agg(F.min_by("gidx", F.struct("unit", "lidx")).alias("idx"))
    return cells.where(p(F.col("value"))).agg(F.min("gidx").alias("idx"))


def find_if_not(a: GridArray, p: Callable[[Column], Column], where: Range = None) -> DataFrame:
    return find_if(a, lambda v: ~p(v), where)


def all_of(a: GridArray, p: Callable[[Column], Column], where: Range = None) -> DataFrame:
    return _cells(a, where).agg(F.coalesce(F.bool_and(p(F.col("value"))), F.lit(True)).alias("result"))


def any_of(a: GridArray, p: Callable[[Column], Column], where: Range = None) -> DataFrame:
    return _cells(a, where).agg(F.coalesce(F.bool_or(p(F.col("value"))), F.lit(False)).alias("result"))


def quantified(a: GridArray, where: Range = None, **tests: Callable[[Column], Column]) -> DataFrame:
    """One row with the answers to several of ``all_of``, ``any_of`` and ``none_of``, from one pass."""
    ask = {"all_of": lambda p: F.coalesce(F.bool_and(p), F.lit(True)), "any_of": lambda p: F.coalesce(F.bool_or(p), F.lit(False)), "none_of": lambda p: ~F.coalesce(F.bool_or(p), F.lit(False))}
    return _cells(a, where).agg(*(ask[name](p(F.col("value"))).alias(name) for name, p in tests.items()))


def none_of(a: GridArray, p: Callable[[Column], Column], where: Range = None) -> DataFrame:
    return _cells(a, where).agg((~F.coalesce(F.bool_or(p(F.col("value"))), F.lit(False))).alias("result"))


def _pairs(a: GridArray, b: GridArray, where: Range, at: int) -> DataFrame:
    """gidx (of a), a, b of a range of a and as many cells of b from ``at`` on; cells missing on a side are null."""
    first, last = where or (0, a.size)
    left = _cells(a, (first, last)).select("gidx", F.col("value").alias("a"))
    right = _cells(b, (at, at + last - first)).select((F.col("gidx") + (first - at)).alias("gidx"), F.col("value").alias("b"))
    return left.join(right, "gidx", "full_outer")


def equal(a: GridArray, b: GridArray, where: Range = None, at: int = 0, p: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """result: whether all pairs of cells agree (null equals null)."""
    same = (lambda x, y: x.eqNullSafe(y)) if p is None else p
    return _pairs(a, b, where, at).agg(F.coalesce(F.bool_and(F.coalesce(same(F.col("a"), F.col("b")), F.lit(False))), F.lit(True)).alias("result"))


def mismatch(a: GridArray, b: GridArray, where: Range = None, at: int = 0) -> DataFrame:
    """idx, a, b of the first pair that differs; one row of nulls if none does."""
    differs = _pairs(a, b, where, at).where(~F.col("a").eqNullSafe(F.col("b")))
    return differs.agg(F.min(F.struct("gidx", "a", "b")).alias("m")).select(F.col("m.gidx").alias("idx"), "m.a", "m.b")


def reduce(a: GridArray, op: ReduceOp = PLUS, init: Column | None = None, where: Range = None, by: str | None = None) -> DataFrame:
    """value: all cells of the range combined, then once with ``init``; ``init`` alone for an empty range.

    ``by`` gives a row for each unit or block."""
    if by:
        cells = a.placed().select(by, a.gidx().alias("gidx"), "value")
        cells = cells if where is None else cells.where((F.col("gidx") >= where[0]) & (F.col("gidx") < where[1]))
        out = cells.groupBy(by).agg(op.many(F.col("value"), F.col("gidx")).alias("value"))
    else:
        out = _cells(a, where).agg(op.many(F.col("value"), F.col("gidx")).alias("value"))
    if init is None:
        return out
    return out.withColumn("value", F.when(F.col("value").isNull(), init).otherwise(op.two(init, F.col("value"))))


def minmax(a: GridArray, where: Range = None) -> DataFrame:
    return _cells(a, where).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def min_element(a: GridArray, where: Range = None, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """idx and value of the smallest cell (by ``key``); nulls for an empty range."""
    k = F.col("value") if key is None else key(F.col("value"))
    cells = _cells(a, where).where(F.col("value").isNotNull())
    return cells.agg(F.min(F.struct(k.alias("k"), F.col("gidx").alias("g"), F.col("value").alias("v"))).alias("m")).select(F.col("m.g").alias("idx"), F.col("m.v").alias("value"))


def max_element(a: GridArray, where: Range = None, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """As ``min_element`` for the largest cell; among equal ones the smallest index."""
    k = F.col("value") if key is None else key(F.col("value"))
    cells = _cells(a, where).where(F.col("value").isNotNull())
    return cells.agg(F.max(F.struct(k.alias("k"), (-F.col("gidx")).alias("g"), F.col("value").alias("v"))).alias("m")).select((-F.col("m.g")).alias("idx"), F.col("m.v").alias("value"))


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Rows numbered 0, 1, ... in an order, without bringing them into one task.

    Rows are parted by ranges of the order, sorted within them and written once; a row's number is its place within
    its part plus the sizes of the parts before it, of which there are as many as partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = parted.withColumn("_place", F.monotonically_increasing_id())
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")


def sort(a: GridArray, where: Range = None, key: Callable[[Column], Column] | None = None) -> GridArray:
    """The cells of a range in ascending order (of ``key``), the others untouched; ties keep the order of indices."""
    first, last = where or (0, a.size)
    k = F.col("value") if key is None else key(F.col("value"))
    cells = a.df.select("gidx", "value")
    inside = (F.col("gidx") >= first) & (F.col("gidx") < last)
    ranked = numbered(cells.where(inside).withColumn("_k", k), "_k", "gidx").select((F.col("rank") + first).alias("gidx"), "value")
    return a.with_df(ranked if where is None else ranked.unionByName(cells.where(~inside)))


def histogram(keys: DataFrame, key: str, bins: int) -> DataFrame:
    """key, n for the keys 0 .. bins-1, zeros included."""
    counts = keys.where((F.col(key) >= 0) & (F.col(key) < bins)).groupBy(F.col(key).cast("long").alias("key")).agg(F.count("*").alias("n"))
    return keys.sparkSession.range(bins).withColumnRenamed("id", "key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def cumulative(hist: DataFrame, bins: int, block: int = 1 << 16) -> DataFrame:
    """key, n, total up to the key: running sums within blocks of keys, on top of the sums of the blocks before."""
    blocked = hist.withColumn("_b", F.expr(f"key div {block}"))
    sums = blocked.groupBy("_b").agg(F.sum("n").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_b", F.coalesce(before, F.lit(0).cast("long")).alias("_start"))
    own = F.sum("n").over(Window.partitionBy("_b").orderBy("key"))
    return blocked.withColumn("_own", own).join(F.broadcast(starts) if bins <= block * 100_000 else starts, "_b").select("key", "n", (F.col("_own") + F.col("_start")).alias("total"))


def sigma(a: GridArray) -> DataFrame:
    """The population's standard deviation."""
    return a.df.agg(F.stddev_pop("value").alias("sigma"))


def div_mean(a: GridArray) -> GridArray:
    """Values divided by their mean; unchanged if their sum isn't positive."""
    total = a.df.agg(F.sum("value").alias("_s"), F.avg("value").alias("_m"))
    df = a.df.crossJoin(F.broadcast(total))  # one row
    return a.with_df(df.withColumn("value", F.when(F.col("_s") > 0, F.col("value") / F.col("_m")).otherwise(F.col("value"))).drop("_s", "_m"))
