"""Approximate nearest neighbours by inner product on randomly rotated one-bit codes.

A block of vectors is stored as codes: each vector, less the block's mean and scaled to length one, is rotated at
random and keeps the signs of its components, one bit each, with correction scalars (its length and its inner
product with its own code). A query is rotated and quantised to a few bits; the inner products of codes and query
come from popcounts of packed bits. The estimate's error has a known scale, and vectors whose upper bound reaches
the k-th best exact product found so far are reranked by the exact product in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
are compared with vectors of their own dimension; rows with a null id take no part; repeated ids among candidates are
rows of their own but not for the query of that id; repeated query ids are one query, the least vector of that id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm import blocks, common

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def _packed_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-signs.shape[1] // 64)
    padded = np.zeros((len(signs), words * 64), np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def pack(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    n, dim = matrix.shape
    return np.array([n, dim], np.int64).tobytes() + ids.astype(np.int64).tobytes() + matrix.astype(np.float64).tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dim = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    return np.frombuffer(payload, np.int64, n, 16), np.frombuffer(payload, np.float64, n * dim, 16 + 8 * n).reshape(n, dim)


def pack_codes(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """As ``pack``, then the block's mean, the vectors' lengths and products with their codes, and the codes."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        mean = matrix.mean(0)
        mean = mean if np.isfinite(mean).all() else np.zeros_like(mean)
        away = matrix - mean
        length = np.sqrt((away * away).sum(1))
        unit = away / np.where(length > 0, length, 1)[:, None]
        turned = np.nan_to_num(unit @ rotation(matrix.shape[1]))
        signs = turned > 0
        own = np.abs(turned).sum(1) / np.sqrt(matrix.shape[1])
    return pack(ids, matrix) + mean.tobytes() + length.tobytes() + own.tobytes() + _packed_bits(signs).tobytes()


def estimates(codes: np.ndarray, own: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products of queries (rows, already rotated) with each code's unit vector, and the queries' quantisation errors."""
    dim = queries.shape[1]
    low = queries.min(1)
    step = (queries.max(1) - low) / ((1 << bits) - 1)
    step[step == 0] = 1.0
    digits = np.rint((queries - low[:, None]) / step[:, None]).astype(np.int64)
    error = np.sqrt(((low[:, None] + step[:, None] * digits - queries) ** 2).sum(1))
    columns = np.ascontiguousarray(codes.T)
    ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
    both = np.zeros((len(queries), len(codes)), np.uint16 if dim << bits < 1 << 16 else np.uint32)
    for b in range(bits):
        plane = _packed_bits((digits >> b & 1).astype(np.uint8))
        for w, column in enumerate(columns):
            both += np.multiply(np.bitwise_count(column & plane[:, w : w + 1]), 1 << b, dtype=both.dtype)
    product = both * (2 * step[:, None]).astype(np.float32)
    product += (2 * low[:, None]).astype(np.float32) * ones
    product -= (step * digits.sum(1) + dim * low)[:, None].astype(np.float32)
    product *= (1 / np.sqrt(dim) / np.maximum(own, 1e-9)).astype(np.float32)
    return product, error


#: Estimates that are held at once: queries times rows.
AT_ONCE = 1 << 18
#: So many times k rows of highest estimates are scored first, for a bound.
FIRST = 5


def best_rows(k: int, bits: int, sureness: float):
    """The k best rows of a block for each query of a block of queries."""

    def run(payload: bytes, wanted: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x = unpack(payload)
        n, dim = x.shape
        at = 16 + 8 * n + 8 * n * dim
        mean = np.frombuffer(payload, np.float64, dim, at)
        length = np.frombuffer(payload, np.float64, n, at + 8 * dim)
        own = np.frombuffer(payload, np.float64, n, at + 8 * dim + 8 * n)
        codes = np.frombuffer(payload, np.uint64, n * -(-dim // 64), at + 8 * dim + 16 * n).reshape(n, -1)
        # the part of a unit vector that its code doesn't tell, by the number of dimensions it is spread over
        unsure = np.sqrt(np.maximum(1 - own**2, 0)) / np.maximum(own, 1e-9) / np.sqrt(max(1, dim - 1))
        by_size = (sureness * length * unsure).astype(np.float32)
        by_error = (sureness * length / np.sqrt(dim) / np.maximum(own, 1e-9)).astype(np.float32)
        # what the order of adding up can change in a product, for each unit of the query's sum of sizes
        slack = 4 * dim * np.finfo(np.float64).eps * float(np.abs(x).max(initial=0))
        qids, queries = unpack(wanted)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        each = max(1, AT_ONCE // n)
        for start in range(0, len(qids), each):
            asked, names = queries[start : start + each], qids[start : start + each]
            guess, error = estimates(codes, own, asked @ rotation(dim), bits)
            guess *= length.astype(np.float32)
            guess += (asked @ mean)[:, None].astype(np.float32)
            upper = guess + np.sqrt((asked * asked).sum(1))[:, None].astype(np.float32) * by_size
            upper += error[:, None].astype(np.float32) * by_error
            for qid, q, about, most in zip(names, asked, guess, upper):
                itself = np.flatnonzero(ids == qid)
                about[itself], most[itself] = -np.inf, -np.inf
                if n - len(itself) > FIRST * k:  # the k-th of some promising rows is a bound for the k-th of all
                    first = np.argpartition(-about, FIRST * k - 1)[: FIRST * k]
                    exact = (x[first] * q).sum(1)
                    found = np.flatnonzero(~(most < np.partition(exact, -k)[-k]))
                    found = found[ids[found] != qid]
                else:
                    found = np.flatnonzero(ids != qid)
                if len(found) > FIRST * k:  # sums in any order, then those that may be among the k best in one order for all
                    rough = x[found] @ q
                    found = found[~(rough < np.partition(rough, -k)[-k] - slack * np.abs(q).sum())]
                scores = (x[found] * q).sum(1)
                top = np.lexsort((ids[found], -scores))[:k]
                out.append((np.full(len(top), qid), ids[found][top], scores[top]))
        return tuple(np.concatenate([part[i] for part in out]) if out else np.zeros(0) for i in range(3))

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, bits: int = 4, sureness: float = 2.5, block_rows: int = 32_768, query_rows: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each id divisible by ``every``."""
    rows = blocks.usable(vectors, "vec_id", "embedding", zero=False)
    n = rows.count()
    index = common.checkpointed(blocks.packed(rows, blocks.rows_of(n, block_rows), pack_codes, n))
    packed = common.checkpointed(blocks.packed(blocks.queries_of(rows, every), query_rows, pack, 0))
    return blocks.search(index, packed, best_rows(k, bits, sureness), k, "double")
