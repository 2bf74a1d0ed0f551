"""Extensions: reductions and histograms over unbounded tables of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_reduce(events: DataFrame, ts: str, value: str, width: str, late: str, key: str | None = None) -> DataFrame:
    """window start, (key,) n, total of fixed windows, for batches and streams. A stream waits ``late`` for rows of a
    window and leaves out those that come after that; a batch is all there, so none of its rows is late."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    groups = [F.window(ts, width).alias("w"), *([F.col(key)] if key else [])]
    out = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *([key] if key else []), "n", "total")


def running_histogram(events: DataFrame, key: str) -> DataFrame:
    """key, n: so far, in a stream to be written in complete or update mode."""
    return events.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
