"""Text quality: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of a text (shares of kinds of characters, repetition of words and lines, word and line lengths) are
standardised; random cosines approximate a Gaussian kernel over them. Each partition sums its part of the normal
equations, the sums meet in Spark, and the driver solves one small system. A further part of the labelled rows
then fits a monotone step function from ridge outputs to probabilities.

Defined results: null and empty texts have statistics of zero and score as such; without labelled rows of both
kinds each score is the share of good labels (1 if there are none); a null doc_id is scored and never held out; texts
of any length are measured whole; repeated rows score alike; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Kinds of bytes: their shares are statistics.
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "newline": b"\r\n", "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|<>[]{}\\/", "mark": b"*#$%&@^~_=+", "quote": b"\"'`()-"}
_TABLE = np.zeros((256, len(_KINDS) + 1))
for _k, _chars in enumerate(_KINDS.values()):
    _TABLE[list(_chars), _k] = 1
_TABLE[128:, len(_KINDS)] = 1
N_STATISTICS = len(_KINDS) + 1 + 9


def statistics(text: str) -> np.ndarray:
    """The statistics of one text, of its whole length."""
    out = np.zeros(N_STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return out
    kinds = np.bincount(data, minlength=256) @ _TABLE / len(data)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    out[: len(kinds)] = np.sqrt(kinds)
    out[len(kinds) :] = (
        np.log1p(n),
        len(seen) / n,
        np.log1p(len(seen)) / np.log1p(n),
        max(seen.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(text) / n / 10,
        len(set(lines)) / len(lines) if lines else 1.0,
        np.log1p(n / max(1, len(lines))),
        sum(w.isalpha() for w in seen) / len(seen),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    threshold: float = 0.3

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.steps
        return np.clip(np.interp(self.raw(x), at, value), 0.0, 1.0)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(phases)) * np.cos(z @ directions + phases)])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing function nearest to ``y`` in squares.

    Equal x are pooled first. Between points the function is interpolated."""
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    weight = np.add.reduceat(np.ones(len(x)) if w is None else w[order], first)
    total = np.add.reduceat(y[order] * (1 if w is None else w[order]), first)
    blocks: list[list[float]] = []  # weight, total, first and last x
    for a, n, s in zip(at, weight, total):
        blocks.append([n, s, a, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, _, last = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += s2
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in [b[1] / b[0]] * 2])
    keep = np.r_[True, (np.diff(xs) > 0) | (np.diff(ys) > 0)]
    return xs[keep], ys[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    texts = column.to_pylist()
    return np.stack([statistics(t or "") for t in texts]) if texts else np.zeros((0, N_STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, most: int = 16_000, cosines: int = 192, width: float = 1.0, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """A classifier from at most ``most`` labelled rows that are not held out (crc32 mod 5 is not 0).

    Four fifths of them (by hash) fit the ridge weights, the rest the calibration. ``width`` scales the kernel's
    width, which is sqrt(number of statistics) for standardised statistics."""
    rng = np.random.default_rng(seed)
    phases = rng.uniform(0, 2 * np.pi, cosines)
    directions = rng.normal(size=(N_STATISTICS, cosines)) / (width * np.sqrt(N_STATISTICS))
    sample = common.labelled_sample(docs, labels, "quality", 5, 0, most)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = common.checkpointed(common.map_arrow(sample, measured, "doc_id long, y int, x array<double>").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))))

    def sums(batches):
        """(row, column, value): the sums of 1, x, x*x of a partition, by column."""
        total = np.zeros((3, N_STATISTICS))
        for batch in batches:
            x = _array(batch)
            total += np.stack([np.full(N_STATISTICS, float(len(x))), x.sum(0), (x * x).sum(0)])
        yield _triples(total)

    n, s, ss = _summed(rows.mapInArrow(sums, "i int, j int, v double"), (3, N_STATISTICS))
    if not n[0]:
        return _constant(1.0)
    mean = s / n
    scale = np.sqrt(np.maximum(ss / n - mean**2, 0)) + 1e-6
    size = cosines + 1

    def equations(batches):
        total = np.zeros((size + 1, size))
        for batch in batches:
            phi, y = features(_array(batch), mean, scale, directions, phases), batch.column("y").to_numpy(zero_copy_only=False)
            total[:size] += phi.T @ phi
            total[size] += phi.T @ y
        yield _triples(total)

    both = rows.groupBy((F.col("part") < 4).alias("fits")).agg(F.countDistinct("y").alias("n"), F.sum("y").alias("y")).collect()
    kinds = {r["fits"]: r["n"] for r in both}
    if rows.select("y").distinct().count() < 2:
        return _constant(sum(r["y"] for r in both) / n[0])
    # a part that lacks one of the labels can't do its work: all rows do it then
    fitted = rows.where("part < 4") if kinds.get(True) == 2 else rows
    normal = _summed(fitted.mapInArrow(equations, "i int, j int, v double"), (size + 1, size))
    count = max(1.0, normal[0, 0])
    weights = np.linalg.solve(normal[:size] / count + ridge * np.eye(size), normal[size] / count)
    model = QualityModel(mean, scale, directions, phases, weights, (np.zeros(1), np.zeros(1)))
    kept = (rows.where("part = 4") if kinds.get(False) == 2 else rows).select("y", "x").toPandas()  # bounded by the sample
    steps = isotonic(model.raw(np.stack(kept["x"].to_numpy())), kept["y"].to_numpy(float))
    return QualityModel(mean, scale, directions, phases, weights, steps)


def _constant(p: float) -> QualityModel:
    return QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros((N_STATISTICS, 1)), np.zeros(1), np.zeros(2), (np.zeros(1), np.full(1, p)))


def _array(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def _triples(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(m)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["i", "j", "v"])


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all partitions' matrices; its size is fixed by the model."""
    out = np.zeros(shape)
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out[found["i"].to_numpy(int), found["j"].to_numpy(int)] = found["v"].to_numpy()
    return out


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        s = m.score(_matrix(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= m.threshold).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, step, "doc_id long, held_out boolean, score double, predicted int")


def of_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` whose texts reach the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        m = sent.value
        return m.score(_matrix(texts)) >= m.threshold

    return common.keep_rows(docs, keep)
