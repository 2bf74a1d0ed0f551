"""What the operators of this subpackage share: label splits, shared storage and Arrow plumbing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column | str, modulus: int, rest: int) -> Column:
    """True where the id's remainder is ``rest``; a null id is never held out."""
    return F.coalesce(remainder(doc_id, modulus) == F.lit(rest), F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = checkpoint_folder(spark)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder in a session of one machine, an error in others."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of a file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stepwise(spark: SparkSession, batch: int = 10_000) -> Iterator[None]:
    """For operators of many steps that write or collect each step's result: inside, an action's shuffle files go as
    soon as it ends, not when the driver happens to collect garbage (a table used again is made again), and Python
    workers are sent ``batch`` rows at once, by which their memory is bounded."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path inside it; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, most: int) -> DataFrame:
    """At most ``most`` training rows (doc_id, text, y): labelled documents that are not held out.

    The rows are those of the smallest hashes of their ids, so the sample is the same on every run; of rows that share
    an id the one with the least text is taken. The ids that are broadcast are bounded by ``most``."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, rest))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


#: Bytes of text that a step is given at once, or one text if that is longer.
MOST_BYTES = 1 << 21


def cuts(batch: pa.RecordBatch, rows: int) -> list[int]:
    """Where a batch is cut: after ``rows`` rows at most, and so that the texts between two cuts have ``MOST_BYTES`` at
    most or are one."""
    if batch.schema.get_field_index("text") < 0 or not pa.types.is_string(batch.schema.field("text").type):
        return [*range(0, batch.num_rows, rows), batch.num_rows]
    _, starts = text_bytes(batch.column("text"))
    out = [0]
    while out[-1] < batch.num_rows:
        fit = int(np.searchsorted(starts, starts[out[-1]] + MOST_BYTES, side="right")) - 1
        out.append(min(max(fit, out[-1] + 1), out[-1] + rows, batch.num_rows))
    return out


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int = 2048) -> DataFrame:
    """``mapInArrow`` with batches cut by rows and bytes of text, so that memory follows neither partitions nor batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cuts(batch, rows)
            for begin, end in zip(at, at[1:]):
                if (out := step(batch.slice(begin, end - begin))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier and its inverse modulo 2**64, for hashes of substrings from prefix sums.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 .. n-1, modulo 2**64."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, BASE_INVERSE if inverse else BASE, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


#: Fixed value: the bytes that part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of each word in ``data``, the UTF-8 bytes of documents that begin at ``starts``.

    ``starts`` has one entry more than there are documents. Words are runs of other bytes than white space
    and never cross a document's border."""
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return b, e, np.searchsorted(starts, b, side="right") - 1


#: Bytes that are hashed at once, or one word if that is longer.
SEGMENT = 1 << 22


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, by prefix sums: the cost is that of the bytes, whatever the spans.

    Spans stand in order and apart; they are gone through in segments, so memory doesn't follow a batch's bytes."""
    out = np.zeros(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        low = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, low + SEGMENT, side="right")))
        part = data[low : end[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(len(part)), out=total[1:])
        b, e = begin[i:j] - low, end[i:j] - low
        out[i:j] = mix64((total[e] - total[b]) * powers(len(part), inverse=True)[b] ^ (e - b).astype(np.uint64))
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (one entry more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    starts = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[starts[0] : starts[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, (starts - starts[0]).astype(np.int64)


def keep_rows(df: DataFrame, keep: Callable[[pa.Array], np.ndarray], rows: int = 2048) -> DataFrame:
    """The rows of ``df``, with all their columns, for whose ``text`` (strings, null as null) ``keep`` gives true."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column("text")), pa.bool_()))

    return map_arrow(df, step, df.schema, rows)
