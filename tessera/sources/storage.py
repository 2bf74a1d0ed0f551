"""Stored arrays: Parquet beside a JSON description that restores the pattern as it was."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.array import GridArray
from tessera.plans.patterns import Pattern, from_json
from tessera.session import checkpointed


def write_array(a: GridArray, path: str, mode: str = "overwrite", convert=None, by_block: bool = False, store_pattern: bool = True, pattern_key: str = "pattern") -> None:
    """The array below ``path``: ``data`` and ``pattern_key``. ``by_block`` puts cells in the order of the pattern's blocks:
    a file holds a range of them, as many as fit a task, so ``views.block`` of what is read finds one by its bounds.

    ``mode`` is overwrite, append (further cells), modify (cells that are there are replaced, others stay) or
    errorifexists; ``convert`` maps values to a storable type."""
    df = a.df if convert is None else a.df.withColumn("value", convert(F.col("value")))
    names, spark = a.index_names, a.df.sparkSession
    df = df.select(*names, "value")
    if mode == "modify":
        old = spark.read.parquet(f"{path}/data").select(*names, "value")
        df = checkpointed(df.unionByName(old.join(df.select(*names), names, "left_anti")))  # what is read is replaced
    if mode == "append" and _matches(spark, f"{path}/data/block=*"):  # beside such folders Spark passes over files
        raise ValueError("this array has a folder for each block, as earlier versions wrote it: write it anew before cells are appended")
    if by_block:
        order = ("block", *names)  # a large block is cut too
        df = df.withColumn("block", a.pattern.block_at(a.coords).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite" if mode == "modify" else mode).parquet(f"{path}/data")
    if store_pattern and mode not in ("append", "modify"):
        spark.createDataFrame([(a.pattern.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{pattern_key}")


def read_array(spark: SparkSession, path: str, pattern: Pattern | None = None, convert=None, pattern_key: str = "pattern") -> GridArray:
    """A stored array with the given pattern, else the stored one, else a plain one of as many cells."""
    df = spark.read.parquet(f"{path}/data")
    if pattern is None:
        try:
            pattern = from_json(spark.read.text(f"{path}/{pattern_key}").head()[0])
        except Exception as e:  # no pattern was stored
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if "gidx" not in df.columns:
                raise ValueError("a matrix without a stored pattern needs one given") from e
            pattern = Pattern.of((df.agg(F.max("gidx")).head()[0] + 1,))
    names = ["gidx"] if len(pattern.extents) == 1 else [f"i{d}" for d in range(len(pattern.extents))]
    if any(n not in df.columns for n in names):
        raise ValueError(f"the stored array doesn't have the {len(names)} indices of the pattern")
    value: Column = F.col("value") if convert is None else convert(F.col("value"))
    return GridArray(df.select(*names, value.alias("value")), pattern)


def _matches(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def remove_array(spark: SparkSession, path: str) -> bool:
    """Removes a stored array; whether there was one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@dataclass
class ArrayStore:
    """A file of named datasets: ``store.dataset("a/b").mode("append") << array``; ``store.dataset("a/b") >> pattern``
    (or None) reads. With ``later()`` writes wait in order until ``flush()``."""

    spark: SparkSession
    path: str
    name: str = "data"
    options: dict = field(default_factory=dict)
    waiting: list | None = None

    def _with(self, **more) -> ArrayStore:
        return ArrayStore(self.spark, self.path, more.pop("name", self.name), self.options | more, self.waiting)

    def dataset(self, name: str) -> ArrayStore:
        return self._with(name=name)

    def mode(self, mode: str) -> ArrayStore:
        return self._with(mode=mode)

    def modify(self) -> ArrayStore:
        return self._with(mode="modify")

    def converter(self, convert) -> ArrayStore:
        return self._with(convert=convert)

    def store_pattern(self, store: bool) -> ArrayStore:
        return self._with(store_pattern=store)

    def pattern_key(self, key: str) -> ArrayStore:
        return self._with(pattern_key=key)

    def by_block(self) -> ArrayStore:
        return self._with(by_block=True)

    def later(self) -> ArrayStore:
        out = self._with()
        out.waiting = []
        return out

    def __lshift__(self, a: GridArray) -> ArrayStore:
        write = (a, f"{self.path}/{self.name}", dict(self.options))
        if self.waiting is None:
            write_array(write[0], write[1], **write[2])
        else:
            self.waiting.append(write)
        return self

    def flush(self) -> None:
        for a, path, options in self.waiting or ():
            write_array(a, path, **options)
        self.waiting = None if self.waiting is None else []

    def read(self, pattern: Pattern | None = None) -> GridArray:
        return read_array(self.spark, f"{self.path}/{self.name}", pattern, self.options.get("convert"), self.options.get("pattern_key", "pattern"))

    __rshift__ = read

    def remove(self) -> bool:
        return remove_array(self.spark, f"{self.path}/{self.name}")


def _numbered_lines(spark: SparkSession, path: str, comment: str = "") -> DataFrame:
    """no, value: the lines of one file that aren't empty or comments, numbers growing from the first one on."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("no"), F.trim("value").alias("value")).where("value <> ''")
    return lines.where(~F.col("value").startswith(comment)) if comment else lines


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst (from zero): both directions of the entries of a symmetric coordinate file; loops are left out.

    The first line that is no comment has the two extents and the number of entries."""
    lines = _numbered_lines(spark, path, "%")
    head = lines.agg(F.min("no")).first()[0]
    fields = F.split("value", r"\s+")
    pairs = lines.where(F.col("no") != (-1 if head is None else head)).select((fields[0].cast("long") - 1).alias("src"), (fields[1].cast("long") - 1).alias("dst")).where("src <> dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a text of compressed sparse rows: the first line has the rows' starts and the end of the last one,
    all further lines have column numbers. A line is read whole by one task; entries meet their rows by a join."""
    lines = _numbered_lines(spark, path)
    head = lines.agg(F.min("no")).first()[0]
    if head is None:
        return spark.createDataFrame([], "src long, dst long")
    numbers = F.transform(F.split("value", r"\s+"), lambda x: x.try_cast("long"))
    sized = lines.where(F.col("no") != head).select("no", numbers.alias("dsts"), F.size(numbers).alias("n"))
    before = F.sum("n").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1))  # a row for each line
    starts = sized.select("no", F.coalesce(before, F.lit(0)).alias("begin"))
    columns = sized.join(starts, "no").select("begin", F.posexplode("dsts").alias("k", "dst")).select((F.col("begin") + F.col("k")).alias("place"), "dst")
    rows = lines.where(F.col("no") == head).select(numbers.alias("at")).select("at", F.posexplode(F.slice("at", 1, F.size("at") - 1)).alias("src", "first"))
    rows = rows.select(F.col("src").cast("long").alias("src"), "first", F.get("at", F.col("src") + 1).alias("last")).where("last > first")
    places = rows.select("src", F.explode(F.sequence("first", F.col("last") - 1)).alias("place"))
    return places.join(columns, "place").select("src", "dst")


def pgm_lines(image: GridArray, most: int = 255) -> DataFrame:
    """line, text: a grey image as plain PGM, one line of text for each row of cells."""
    rows, cols = image.pattern.extents
    pixel = F.greatest(F.lit(0), F.least(F.lit(most), F.round("value").cast("int")))
    cells = image.df.select("i0", F.struct(F.col("i1"), pixel.alias("p")).alias("c")).groupBy("i0").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    body = cells.select((F.col("i0") + 3).alias("line"), F.array_join(F.transform("cs", lambda c: c["p"].cast("string")), " ").alias("text"))
    header = image.df.sparkSession.createDataFrame([(0, "P2"), (1, f"{cols} {rows}"), (2, str(most))], "line long, text string")
    return header.unionByName(body)
