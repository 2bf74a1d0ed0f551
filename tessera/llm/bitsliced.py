"""Exact top-k search by inner product of integers on a bit-sliced index.

A block of vectors is stored as bitmaps: for each attribute and each bit of its quantised value, one bit for each
row. A query's score is the sum of its digits times these slices, added for all rows at once with bitmap
arithmetic (carry-save adders, weight by weight). The sum's slices are walked from the most significant one
downward to find the k-th largest sum; quantisation leaves an error with a known bound, and the rows within that
bound of the k-th largest sum, the boundary rows, are scored exactly from their whole values.

Vectors with a quantised component beyond +-2**27, whose products could leave 64 bits, stand in blocks of their own,
which are scored in whole numbers of any size; they are expected to be few.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; sums beyond 64 bits
count as the nearest number of 64 bits, quantised components beyond the largest double as that one; vectors are
compared with vectors of their own dimension; rows with a null id take no part; repeated ids among candidates are rows
of their own but not for the query of that id; repeated query ids are one query, the least vector of that id.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import blocks, common

LIMIT = 1 << 27
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LARGEST = sys.float_info.max


def pack(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """Ids and whole values of a block."""
    n, dim = matrix.shape
    return np.array([n, dim], np.int64).tobytes() + ids.astype(np.int64).tobytes() + matrix.astype(np.int32).tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dim = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    return np.frombuffer(payload, np.int64, n, 16), np.frombuffer(payload, np.int32, n * dim, 16 + 8 * n).reshape(n, dim)


def pack_slices(bits: int):
    """As ``pack``, then the shift and the slices: attribute, bit, row, with 64 rows to a word."""

    def run(ids: np.ndarray, matrix: np.ndarray) -> bytes:
        x = matrix.astype(np.int64)
        shift = max(0, int(np.abs(x).max(initial=0)).bit_length() + 1 - bits)
        u = (x >> shift) + (1 << (bits - 1))
        words = -(-len(ids) // 64)
        planes = np.zeros((x.shape[1], bits, words * 8), np.uint8)
        for b in range(bits):
            planes[:, b, : -(-len(ids) // 8)] = np.packbits((u >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        return pack(ids, matrix) + np.array([shift, bits, words], np.int64).tobytes() + planes.tobytes()

    return run


def add_up(addends: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The slices, least significant first, of the sum of bitmaps of given weights (powers of two)."""
    out, weight = [], 0
    while addends and weight <= max(addends):
        own = [x for x in addends.pop(weight, []) if len(x)]
        level = np.concatenate(own) if own else np.zeros((0, words), np.uint64)
        while len(level) > 1:
            n = len(level) // 3
            if n:
                a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
                half = a ^ b
                carry = (a & b) | (half & c)
                level = np.concatenate([half ^ c, level[3 * n :]])
            else:
                carry = level[:1] & level[1:]
                level = level[:1] ^ level[1:]
            addends.setdefault(weight + 1, []).append(carry)
        out.append(level[0] if len(level) else np.zeros(words, np.uint64))
        weight += 1
    return out


def at_least(slices: list[np.ndarray], least: int, rows: np.ndarray) -> np.ndarray:
    """The bitmap of those ``rows`` whose number in ``slices`` is ``least`` or more."""
    if least <= 0:
        return rows
    if least.bit_length() > len(slices):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows.copy()
    for i in range(len(slices) - 1, -1, -1):
        if least >> i & 1:
            equal &= slices[i]
        else:
            more |= equal & slices[i]
            equal &= ~slices[i]
    return more | equal


def kth_largest(slices: list[np.ndarray], k: int, rows: np.ndarray) -> int:
    """The k-th largest number in ``slices`` over ``rows``, from the most significant slice downward; 0 if there are fewer."""
    if int(np.bitwise_count(rows).sum()) < k:
        return 0
    value, wanted, open_rows = 0, k, rows
    for i in range(len(slices) - 1, -1, -1):
        ones = open_rows & slices[i]
        n = int(np.bitwise_count(ones).sum())
        if n >= wanted:
            value |= 1 << i
            open_rows = ones
        else:
            wanted -= n
            open_rows = open_rows & ~slices[i]
    return value


def best_rows(k: int, digits: int):
    """The k best rows of a block for each query of a block of queries; queries are quantised to ``digits`` bits."""

    def run(payload: bytes, wanted: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x = unpack(payload)
        n, dim = x.shape
        at = 16 + 8 * n + 4 * n * dim
        shift, bits, words = (int(v) for v in np.frombuffer(payload, np.int64, 3, at))
        planes = np.frombuffer(payload, np.uint64, dim * bits * words, at + 24).reshape(dim, bits, words)
        qids, queries = unpack(wanted)
        everything = np.zeros(words * 64, np.uint8)
        everything[:n] = 1
        everything = np.packbits(everything, bitorder="little").view(np.uint64)
        low = x >> shift << shift
        longest = float(np.sqrt((low.astype(np.float64) ** 2).sum(1).max(initial=0)))
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        out_q, out_r, out_s = [], [], []
        for qid, q in zip(qids, queries.astype(np.int64)):
            rows = everything
            own = order[np.searchsorted(sorted_ids, qid) : np.searchsorted(sorted_ids, qid, side="right")]
            if len(own):
                rows = rows.copy()
                for r in own:
                    rows[r >> 6] &= ~np.uint64(1 << (int(r) & 63))
            drop = max(0, int(np.abs(q).max()).bit_length() - digits)
            coarse = (q + (1 << drop >> 1)) >> drop
            rest = q - (coarse << drop)
            size = np.abs(coarse)
            turned = np.where(coarse < 0, ~np.uint64(0), np.uint64(0))
            addends: dict[int, list[np.ndarray]] = {}
            for digit in range(int(size.max()).bit_length()):
                js = np.flatnonzero(size >> digit & 1)
                if len(js):
                    chosen = planes[js] ^ turned[js][:, None, None]
                    for b in range(bits):
                        addends.setdefault(digit + b, []).append(chosen[:, b])
            slices = add_up(addends, words)
            # score = 2**(shift+drop) * sum + a constant + error; the error lies in an interval of this width
            spread = ((1 << shift) - 1) * float(np.abs(q).sum()) + 2 * float(np.sqrt((rest.astype(np.float64) ** 2).sum())) * longest
            least = kth_largest(slices, k, rows) - int(np.ceil(spread / 2.0 ** (shift + drop))) - 1
            marked = at_least(slices, least, rows)
            found = np.flatnonzero(np.unpackbits(marked.view(np.uint8), count=n, bitorder="little"))
            scores = x[found].astype(np.int64) @ q
            top = np.lexsort((ids[found], -scores))[:k]
            out_q.append(np.full(len(top), qid))
            out_r.append(ids[found][top])
            out_s.append(scores[top])
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_q, out_r, out_s))

    return run


def pack_wide(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """As ``pack``, for whole values of any size, which are doubles."""
    return np.array(matrix.shape, np.int64).tobytes() + ids.astype(np.int64).tobytes() + matrix.astype(np.float64).tobytes()


def unpack_wide(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dim = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    return np.frombuffer(payload, np.int64, n, 16), np.frombuffer(payload, np.float64, n * dim, 16 + 8 * n).reshape(n, dim)


def best_wide_rows(k: int):
    """As ``best_rows``, for blocks of ``pack_wide``: sums in long doubles find the rows that are scored exactly."""

    def run(payload: bytes, wanted: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x = unpack_wide(payload)
        rough = x.astype(np.longdouble)
        size = np.abs(rough)
        out = []
        for qid, q in zip(*unpack_wide(wanted)):
            rows = np.flatnonzero(ids != qid)
            about = (rough @ q.astype(np.longdouble))[rows]
            error = (size @ np.abs(q).astype(np.longdouble))[rows] * np.finfo(np.longdouble).eps * (len(q) + 2)
            low, high = (np.clip(v, LEAST, MOST) for v in (about - error, about + error))
            if len(rows) > k:
                rows = rows[high >= np.partition(low, len(low) - k)[len(low) - k]]
            whole = [int(v) for v in q]
            scores = [min(max(sum(int(a) * b for a, b in zip(x[i], whole)), LEAST), MOST) for i in rows]
            top = sorted(zip((-v for v in scores), ids[rows].tolist()))[:k]
            out += [(qid, i, -v) for v, i in top]
        return tuple(np.array([row[c] for row in out], np.int64) for c in range(3))

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 256.0, bits: int = 7, digits: int = 5, block_rows: int = 65_536, query_rows: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(factor * vector), for each id divisible by ``every``."""
    rows = blocks.usable(vectors, "vec_id", "embedding", zero=True)
    # Spark's floor gives 64 bits; doubles from 2**53 on are whole
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.least(x * F.lit(factor), F.lit(LARGEST)), F.lit(-LARGEST))))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)))
    narrow = F.forall("vector", lambda x: F.abs(x) <= LIMIT)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~narrow).alias("wide")).first()
    plain, n = rows.where(narrow), counts["n"] - counts["wide"]
    index = common.checkpointed(blocks.packed(plain, blocks.rows_of(n, block_rows, 16_384), pack_slices(bits), n))
    queries = blocks.queries_of(rows, every)
    query_rows = blocks.rows_of(n // every, query_rows, 512, 3)
    packed = common.checkpointed(blocks.packed(queries.where(narrow), query_rows, pack, 0))
    found = blocks.search(index, packed, best_rows(k, digits), k, "long")
    if not counts["wide"]:
        return found
    for own, n_own, asked in ((rows.where(~narrow), counts["wide"], queries), (plain, n, queries.where(~narrow))):
        index = common.checkpointed(blocks.packed(own, block_rows, pack_wide, n_own))
        packed = common.checkpointed(blocks.packed(asked, query_rows, pack_wide, 0))
        found = found.unionByName(blocks.search(index, packed, best_wide_rows(k), k, "long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
