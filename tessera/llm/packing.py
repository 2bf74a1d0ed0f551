"""Best-fit packing of documents into training sequences of several permitted lengths.

Items are dealt by hash to shards of a bounded size, each packed by itself: in order of decreasing length an item
goes to the open bin with the least room that still fits it. Where no bin fits, a new one is opened; its size is
the permitted length that would cost least for each token it could hold, judged by filling it from the items that
are left. At the end each bin is downsized to the shortest permitted length that holds its contents.

A sequence of n tokens costs n + n*n/quadratic: a linear part and one that grows with the square, as attention does.

Texts longer than the longest sequence are cut into consecutive pieces of that length and a rest; nothing is
dropped. Defined results: an empty or null text has the closing token alone; rows with a null id are packed as any
other; equal rows are packed as items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


@dataclass(frozen=True)
class Sizes:
    """Permitted sequence lengths in tokens, ascending, and what they cost."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    quadratic: float = 65536.0

    def cost(self, n: int) -> float:
        return n + n * n / self.quadratic

    def holding(self, tokens: int) -> int:
        return next(c for c in self.lengths if c >= tokens)


def lengths(docs: DataFrame, closing: int = 1) -> DataFrame:
    """doc_id, n_tokens, deal: words of the whole text and ``closing`` tokens that end it; deal spreads rows over shards."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = common.text_bytes(batch.column("text"))
        _, _, doc = common.word_spans(data, starts)
        n = np.bincount(doc, minlength=batch.num_rows) + closing
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("deal")], ["doc_id", "n_tokens", "deal"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("deal"))
    return common.map_arrow(rows, step, "doc_id long, n_tokens long, deal long")


def pieces(items: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start, n_tokens, deal: items cut to at most ``longest`` tokens."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(longest))).cast("long")
    cut = items.select("doc_id", "deal", F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("whole") - start).cast("int").alias("n_tokens"), F.xxhash64("deal", "piece").alias("deal"))


def best_fit(items: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin and final bin size of each item, given the items' lengths (1 to the longest)."""
    order = np.argsort(-items, kind="stable")
    longest = sizes.lengths[-1]
    left = np.bincount(items, minlength=longest + 1).tolist()
    present = 0  # bit n: an item of length n is left
    for n, c in enumerate(left):
        if c:
            present |= 1 << n
    rooms: list[list[int]] = [[] for _ in range(longest + 1)]  # open bins by room
    with_room = 0  # bit n: a bin with room n is open
    used: list[int] = []
    bins, places = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)

    def size_to_open(n: int) -> int:
        best = None
        for size in sizes.lengths:
            if size < n:
                continue
            room, taken = size - n, {}
            while room:
                fit = present & ((1 << (room + 1)) - 1)
                while fit and (at := fit.bit_length() - 1) and taken.get(at, 0) >= left[at]:
                    fit &= ~(1 << at)
                if not fit:
                    break
                many = min(left[at] - taken.get(at, 0), room // at)
                taken[at] = taken.get(at, 0) + many
                room -= at * many
            held = size - room
            rate = sizes.cost(sizes.holding(held)) / held
            if best is None or rate < best[0] - 1e-12:
                best = (rate, size)
        return best[1]

    for i in order:
        n = int(items[i])
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fitting = with_room >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                with_room &= ~(1 << room)
        else:
            room = size_to_open(n)
            b = len(used)
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += n
        if rest := room - n:
            rooms[rest].append(b)
            with_room |= 1 << rest
    final = np.array([sizes.holding(u) for u in used], np.int64)
    return bins, places, final[bins] if len(final) else bins


#: Equal pieces that go to one shard together.
TOGETHER = 1024


def pack(items: DataFrame, sizes: Sizes = Sizes(), shard_rows: int = 40_000) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, place, bin_size: one row for each piece.

    A shard has about ``shard_rows`` pieces at every input size, so tasks stay alike as the input grows. Equal pieces
    (of equal rows) are counted first and dealt in groups of ``TOGETHER``, so no row that repeats fills a shard."""
    same = ["doc_id", "piece", "start", "n_tokens", "deal"]
    cut = common.checkpointed(pieces(items, sizes.lengths[-1]).groupBy(*same).agg(F.count("*").alias("n")))
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_rows))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("part", "ascending")])
        first = group.column("shard")[0].as_py() << 32
        group = group.take(np.repeat(np.arange(group.num_rows), group.column("n").to_numpy()))
        bins, places, final = best_fit(group.column("n_tokens").to_numpy(), sizes)
        return pa.table([group.column("doc_id"), group.column("piece"), group.column("start"), group.column("n_tokens"), pa.array(first + bins), pa.array(places), pa.array(final, pa.int32())], ["doc_id", "piece", "start", "n_tokens", "bin_id", "place", "bin_size"])

    parts = cut.select(*same, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {TOGETHER}"))).alias("part"))
    parts = parts.withColumn("n", F.least(F.lit(TOGETHER).cast("long"), F.col("n") - F.col("part") * TOGETHER))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("deal", "part"), F.lit(shards).cast("long")))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens int, bin_id long, place long, bin_size int")
