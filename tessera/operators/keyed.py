"""Maps, lists, coarrays, counters and atomic updates, as batches.

What units do one after another in shared memory is here an update table with a sequence column; the result is that
of applying the updates in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.reduce_ops import PLUS, SECOND, ReduceOp


def map_unit(key: Column, units: int, whole: bool = False) -> Column:
    """The unit of a key where the producer names none: by hash, or by the key itself where keys are whole numbers."""
    return F.pmod(key if whole else F.hash(key), F.lit(units)).cast("int")


def bucket(m: DataFrame, units: int, whole: bool = False) -> DataFrame:
    """The map with the unit that holds each key."""
    return m.withColumn("unit", map_unit(F.col("key"), units, whole))


def folded_before(updates: DataFrame, op: ReduceOp, key: str = "gidx", order: str = "seq", value: str = "value") -> DataFrame:
    """The updates with ``_before``: op over the earlier updates of the same key, null where there are none.

    A key's updates are cut into spans of 2**16 numbers of their order; windows run within spans, and over one row for
    each span, so a key that has most of the rows is spread over tasks."""
    rows = updates.withColumn("_span", F.shiftright(order, 16))
    w = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(key, "_span").agg(op.many(F.col(value), F.col(order)).alias("_all"))
    starts = spans.withColumn("_start", op.many(F.col("_all"), F.col("_span")).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_own", op.many(F.col(value), F.col(order)).over(w)).join(starts.drop("_all"), [key, "_span"])
    before = F.when(F.col("_own").isNull(), F.col("_start")).when(F.col("_start").isNull(), F.col("_own")).otherwise(op.two(F.col("_start"), F.col("_own")))
    return rows.select(*updates.columns, before.alias("_before"))


def insert_first_wins(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """key, mapped: the map after inserting (key, mapped, seq); a key that is there already keeps its value."""
    new = batch.groupBy("key").agg(F.min_by("mapped", "seq").alias("mapped"))
    if existing is None:
        return new
    return existing.select("key", "mapped").unionByName(new.join(existing, "key", "left_anti"))


def insert_flags(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The batch with ``inserted``: whether the row's insertion took effect."""
    first = batch.groupBy("key").agg(F.min("seq").alias("_first"))
    if existing is not None:
        first = first.join(existing.select("key"), "key", "left_anti")
    return batch.join(first, "key", "left").withColumn("inserted", F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).drop("_first")


def insert_range(batch: DataFrame, first: int, last: int, existing: DataFrame | None = None) -> DataFrame:
    """The map after inserting the part of a batch whose seq is in [first, last)."""
    return insert_first_wins(batch.where((F.col("seq") >= first) & (F.col("seq") < last)), existing)


def insert_hinted(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """key, mapped of a batch (key, mapped, seq, hint): as ``insert_first_wins``; the hint, a key near which to look,
    is a matter of speed alone, and a shuffle by key needs none."""
    return insert_first_wins(batch.drop("hint"), existing)


def update_mapped(m: DataFrame, updates: DataFrame, op: ReduceOp = PLUS) -> DataFrame:
    """key, mapped: the map after op= of all updates (key, value, seq) to its values; keys that are not there stay out."""
    combined = updates.groupBy("key").agg(op.many(F.col("value"), F.col("seq")).alias("_u"))
    joined = m.select("key", "mapped").join(combined, "key", "left")
    return joined.select("key", F.when(F.col("_u").isNull(), F.col("mapped")).otherwise(op.two(F.col("mapped"), F.col("_u"))).alias("mapped"))


def lookup(m: DataFrame, keys: DataFrame, default: Column | None = None) -> DataFrame:
    """The keys with ``found`` and ``mapped`` (or the default where a key is absent)."""
    joined = keys.join(m.select("key", F.struct("mapped").alias("_m")), "key", "left")
    return joined.select(*keys.columns, F.col("_m").isNotNull().alias("found"), F.coalesce(F.col("_m.mapped"), F.lit(None) if default is None else default).alias("mapped"))


def at(m: DataFrame, key: object) -> object:
    """The value of one key, or a KeyError."""
    found = m.where(F.col("key") == key).select("mapped").head()
    if found is None:
        raise KeyError(key)
    return found[0]


def erase(m: DataFrame, keys: DataFrame) -> DataFrame:
    """An extension: the map without some keys."""
    return m.join(keys.select("key"), "key", "left_anti")


def bucket_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy("unit").agg(F.count("*").alias("n"))


COUNT = ReduceOp("count", lambda v, g: F.sum(v), lambda a, b: a + b)


def push_back(items: DataFrame, more: DataFrame) -> DataFrame:
    """unit, lseq, value: a list with each unit's new values (unit, seq, value) after its old ones."""
    last = items.groupBy("unit").agg((F.max("lseq") + 1).alias("_next"))  # a row for each unit
    placed = folded_before(more.withColumn("_one", F.lit(1).cast("long")), COUNT, "unit", "seq", "_one")
    new = placed.join(last, "unit", "left").select("unit", (F.coalesce("_next", F.lit(0)) + F.coalesce("_before", F.lit(0))).cast("long").alias("lseq"), "value")
    return items.select("unit", F.col("lseq").cast("long").alias("lseq"), "value").unionByName(new)


def coreduce(c: DataFrame, index: list[str], op: ReduceOp = PLUS, image: int | None = None, images: int | None = None) -> DataFrame:
    """Element-wise reduction of a coarray over its images, to one image or to all."""
    out = c.groupBy(*index).agg(op.many(F.col("value"), F.col("image")).alias("value"))
    if image is not None:
        return out.withColumn("image", F.lit(image))
    return out if images is None else out.withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(images - 1))))


def cobroadcast(c: DataFrame, image: int, images: int) -> DataFrame:
    """Every image with the values of one of them."""
    return c.where(F.col("image") == image).withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(images - 1))))


def counter_get(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def fetch_op(updates: DataFrame, initial: DataFrame | None = None, op: ReduceOp = PLUS, start: Column | None = None) -> DataFrame:
    """The updates (gidx, seq, value) with ``fetched``: what the cell held before each, its initial value (of a table
    or ``start``, null if neither tells) combined with the earlier updates by op."""
    out = folded_before(updates, op)
    first = F.lit(None) if start is None else start
    if initial is not None:
        out = out.join(initial.select("gidx", F.col("value").alias("_first")), "gidx", "left")
        first = F.coalesce("_first", first)
    before = F.col("_before")
    return out.withColumn("fetched", F.when(before.isNull(), first).when(first.isNull(), before).otherwise(op.two(first, before))).select(*updates.columns, "fetched")


def fetch_add(updates: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    return fetch_op(updates, initial, PLUS, F.lit(0))


def fetch_sub(updates: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """As ``fetch_op``, with the values taken off; ``value`` stays as it was."""
    negative = updates.withColumn("_v", F.col("value")).withColumn("value", -F.col("value"))
    return fetch_op(negative, initial, PLUS, F.lit(0)).withColumn("value", F.col("_v")).drop("_v")


def exchange(updates: DataFrame) -> DataFrame:
    """The updates (gidx, seq, value) with ``fetched``: what the cell held before, null at first."""
    return fetch_op(updates, op=SECOND)


def store_last(updates: DataFrame) -> DataFrame:
    return updates.groupBy("gidx").agg(F.max_by("value", "seq").alias("value"))


def compare_exchange(updates: DataFrame, initial: Column) -> DataFrame:
    """gidx, value, n: each cell after its updates (seq, expected, desired), and how many took effect.

    A cell's updates depend on one another, so they are folded in their order in one place."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "expected", "desired")))
    start = F.struct(initial.alias("v"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, u: F.when(acc["v"] == u["expected"], F.struct(u["desired"].alias("v"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return updates.groupBy("gidx").agg(F.aggregate(rows, start, step).alias("s")).select("gidx", F.col("s.v").alias("value"), F.col("s.n").alias("n"))
