"""Language-model scores by an interpolated modified Kneser-Ney n-gram model of any order from two up.

Training counts words, then the grams of the highest order, in Spark: each task reduces its part to sorted arrays of
hashes with counts, the arrays are dealt to shards, and a shard merges its arrays. Grams are dealt by the word before
their last, so that a context's statistics are whole in one shard and so are the shorter grams that end the longer
ones: a shard finds the counts of all its orders from its longest grams. The few words that begin very many pairs are
dealt by two words; their pairs, of which several shards have a part, are summed by the second word. Shards write the
model as sorted hash arrays (those of many keys behind a directory of the keys' leading bits) to files in the shared folder, which workers map into memory to score texts, so a model
larger than a worker's memory still serves. All grams are kept, those seen once too.

A gram of count c has probability max(c - D(c), 0) / c(context), and what the discounts leave goes to the gram without
its first word. Grams of the highest order and those at the start of a text have their counts; others have the number
of distinct words before them. Single words are interpolated with the uniform distribution over the known words and
one unknown word. Each order's discounts for counts of one, two and more come from its counts of counts.

Tokens are the words of the whole text, letters A-Z as a-z, and one end. Defined results: null and empty texts are
the end alone; without training texts all probabilities are one; texts of any length are scored whole; repeated rows
score alike; rows with a null id are trained on; further columns are left out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Hashes of the tokens that are no words.
END, BEGIN = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0xBE61BE61BE61BE63)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a batch's texts, each text closed by END, and where each text starts."""
    data, starts = common.text_bytes(batch.column("text"))
    lowered = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    begin, end, doc = common.word_spans(data, starts)
    words = common.word_hashes(lowered, begin, end)
    n = np.bincount(doc, minlength=batch.num_rows) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(words)) + doc] = words
    return out, first


def short(words: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash, by which grams are told apart."""
    return words >> np.uint64(16)


def counted(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and, for each, the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], *(np.add.reduceat(c[order], new, dtype=np.int64 if c.dtype == bool else None) if len(new) else c[:0] for c in columns)


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Discounts:
    """What is taken off counts of one, two, and three or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[float]) -> Discounts:
        """From how many counts are one, two, three and four."""
        if n[0] <= 0:
            return cls(0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        taken = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] > 0 else (k + 1) * y for k in range(3)]
        return cls(*(min(max(d, 0.05), k + 1.0) for k, d in enumerate(taken)))

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= 0, 0.0, np.where(c == 1, self.one, np.where(c == 2, self.two, self.more)))

    def mass(self, n1, n2, n3):
        return self.one * n1 + self.two * n2 + self.more * n3


@dataclass(frozen=True)
class Model:
    """Totals of a model and where its files are."""

    folder: str
    shards: int
    bits: int = 6  # words are parted into 2**bits tables by their hashes' leading bits
    order: int = 2
    hot: tuple[int, ...] = ()  # words, as 48 bits and sorted
    hot_stats: tuple[tuple[int, ...], ...] = ()  # for each of them as a context: total, grams of count one, two, more
    tokens: int = 0  # N
    words: int = 0  # V
    continuations: int = 0  # distinct pairs
    discounts: tuple[Discounts, ...] = ()  # by order, from 1
    single_mass: float = 0.0


def _dealt(rows: DataFrame, name: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, list[np.ndarray]]]], flush: int = 6_000_000) -> DataFrame:
    """(shard, parts): each task's arrays, reduced and dealt to shards whenever ``flush`` tokens are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            stream = np.concatenate([t for t, _ in held])
            shift = np.cumsum([0] + [len(t) for t, _ in held])
            first = np.concatenate([f[:-1] + s for (_, f), s in zip(held, shift)] + [[shift[-1]]]).astype(np.int64)
            held.clear()
            for shard, arrays in name(stream, first):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))], ["shard", "parts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = tokens(batch.slice(at, 2048))
                held.append(part)
                size += len(part[0])
                if size >= flush:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return rows.select("text").mapInArrow(run, "shard int, parts array<binary>")


def _merged(parts: pa.ChunkedArray, kinds: tuple[type, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a shard's rows end to end."""
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for row in parts:
        for column, kind, value in zip(columns, kinds, row):
            column.append(np.frombuffer(value.as_buffer(), kind))
    return tuple(np.concatenate(c) for c in columns)


def _slices(keys: np.ndarray, shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Keys and columns by shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(order) else []
    for i, j in zip(cut, [*cut[1:], len(order)]):
        rows = order[i:j]
        yield int(shard[rows[0]]), [keys[rows], *(c[rows] for c in columns)]


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """A file of the model, put in place whole: a task that runs twice writes the same bytes."""
    fs, path = common.open_fs(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(array.tobytes())
    fs.move(draft, f"{path}/{name}")


#: Counts below this are bytes in the files of counts; rows with a larger one stand in a file of their own.
LARGE = 255


#: From this many keys on a file has a directory by the keys' leading 16 bits, which takes no more than it saves.
FILED = 1 << 16


def _write_counts(folder: str, name: str, key: np.ndarray, counts: np.ndarray, bits: int = 64) -> None:
    """Sorted keys of ``bits`` bits with a row of counts each: words have their 64 bits, grams and contexts 48.

    Files of many keys of 48 bits hold a directory of where each value of their leading 16 bits starts, and the other 32."""
    counts = counts.astype(np.int64).reshape(len(key), 1 if counts.ndim == 1 else counts.shape[1])
    many = np.flatnonzero((counts >= LARGE).any(1))
    key = key.astype(np.uint64)
    if bits == 48 and len(key) >= FILED:
        _write(folder, f"{name}.first", np.searchsorted(key, np.arange(FILED + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint32))
        _write(folder, f"{name}.rest", key.astype(np.uint32))
    else:
        _write(folder, f"{name}.key", key)
    _write(folder, f"{name}.count", np.minimum(counts, LARGE).astype(np.uint8))
    _write(folder, f"{name}.large", np.concatenate([many, counts[many].ravel()]))


def place_of(keys: np.ndarray, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Where keys of 48 bits stand in a file with a directory, -1 for absent ones: all are halved in on at once."""
    top, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
    at, end = first[top].astype(np.int64), first[top + 1].astype(np.int64)
    last = end
    for _ in range(int((end - at).max(initial=0)).bit_length()):
        middle = (at + end) >> 1
        before = (at < end) & (rest[np.minimum(middle, len(rest) - 1)] < low)
        at, end = np.where(before, middle + 1, at), np.where(before, end, middle)
    return np.where((at < last) & (rest[np.minimum(at, len(rest) - 1)] == low), at, -1)


def chained(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a gram, 48 bits, from the key of all but its last word (of one word: its 48 bits) and that word's."""
    return short(common.mix64(key * _GOLDEN + word))


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0]
    for word in columns[1:]:
        key = chained(key, word)
    return key


def distinct(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below 2**bits, in order, and how often each occurs."""
    if len(columns) * bits <= 64:
        packed = columns[0].astype(np.uint64)
        for c in columns[1:]:
            packed <<= np.uint64(bits)
            packed |= c.astype(np.uint64)
        packed.sort()
        new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        n = np.diff(np.concatenate([new, [len(packed)]]))
        packed, mask = packed[new], np.uint64((1 << bits) - 1)
        return [packed >> np.uint64(bits * (len(columns) - 1 - i)) & mask for i in range(len(columns))], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)]))
    return [c[new] for c in columns], np.diff(np.concatenate([new, [len(order)]]))


def grams_of(stream: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct grams that end in each token, with as many BEGIN before a text as they need: the words before the
    last from the nearest to the farthest, the last word (48 bits each), and counts."""
    words, ids = np.unique(np.concatenate([short(stream), [short(BEGIN)]]), return_inverse=True)
    pad, texts = order - 1, len(first) - 1
    at = np.arange(len(stream)) + pad * (np.repeat(np.arange(texts), np.diff(first)) + 1)
    padded = np.full(len(stream) + pad * texts, ids[-1], np.uint32)
    padded[at] = ids[:-1]
    del ids
    columns, n = distinct([padded[at - d] for d in (*range(1, order), 0)], max(1, (len(words) - 1).bit_length()))
    return [words[c] for c in columns], n


def _squeezed(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2**32, byte by byte and compressed, behind their size."""
    planes = np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return np.frombuffer(np.int64(planes.size).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True), np.uint8)


def _unsqueezed(value: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(value[8:].tobytes(), int(value[:8].view(np.int64)[0]), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32)[:, 0]


def encoded(columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Sorted grams as a tree. First the words, the most frequent first, in two arrays; then for each column the numbers
    of the words where it or one before it changes, and how many entries of the next column belong to each, for the
    last column the counts."""
    starts, change = [], np.zeros(len(n), bool)
    for c in columns:
        change |= np.concatenate([[True], c[1:] != c[:-1]])
        starts.append(np.flatnonzero(change))
    words, ids, times = np.unique(np.concatenate([c[i] for c, i in zip(columns, starts)]), return_inverse=True, return_counts=True)
    by_times = np.argsort(-times, kind="stable")
    number = np.empty(len(words), np.uint32)
    number[by_times] = np.arange(len(words), dtype=np.uint32)
    words, ids = words[by_times], number[ids]
    runs = [*(np.diff(np.searchsorted(j, np.append(i, len(n)))) for i, j in zip(starts, starts[1:])), n]
    ids = np.split(ids, np.cumsum([len(i) for i in starts])[:-1])
    return [(words >> np.uint64(16)).astype(np.uint32), (words & np.uint64(0xFFFF)).astype(np.uint16), *(_squeezed(x) for pair in zip(ids, runs) for x in pair)]


def decoded(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """What ``encoded`` was given, from the bytes of its arrays."""
    high, low = np.frombuffer(parts[0], np.uint32), np.frombuffer(parts[1], np.uint16)
    words = high.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64)
    ids, run = [], None
    for i in range(2, len(parts), 2):
        if run is not None:
            ids = [np.repeat(c, run) for c in ids]
        ids.append(_unsqueezed(np.frombuffer(parts[i], np.uint8)))
        run = _unsqueezed(np.frombuffer(parts[i + 1], np.uint8))
    return [words[c] for c in ids], run.astype(np.int64)


def _found(n: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four, and how many there are."""
    return [*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n)]


def _context_stats(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts and for each its total and how many of its grams have count one, two and more."""
    return counted(context, n, n == 1, n == 2, n > 2)


def _is_hot(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words


def fit(texts: DataFrame, n_texts: int, folder: str, per_shard: int = 4_000_000, order: int = 2) -> Model:
    """Counts the whole training texts and writes the model's files to ``folder``.

    A shard has the pairs of ``per_shard`` tokens, or longer grams of as many words in all. Only totals and the hot words with their statistics come to
    the driver; there are at most 8 for each shard, chosen from 16."""
    if order < 2:
        raise ValueError("the order is two at least")
    bits = table_bits(n_texts)
    tables = 1 << bits

    def words(stream, first):
        keys, n = counted(stream, np.ones(len(stream), np.int64))
        yield from _slices(keys, (keys >> np.uint64(64 - bits)).astype(np.int64), n.astype(np.uint32))

    def add_words(group: pa.Table) -> pa.Table:
        """A table of words, written; its words that may be hot. With one shard, none needs to be."""
        keys, n = counted(*_merged(group.column("parts"), (np.uint64, np.uint32)))
        n = n.astype(np.int64)
        _write_counts(folder, f"words-{group.column('shard')[0].as_py()}", keys, n)
        often = np.flatnonzero(n > per_shard // (8 * order))
        return pa.table([pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([short(keys[often]).astype(np.int64)], pa.list_(pa.int64())), pa.array([n[often]], pa.list_(pa.int64()))], ["words", "tokens", "hot", "n"])

    vocabulary = common.checkpointed(_dealt(texts, words).groupBy("shard").applyInArrow(add_words, "words long, tokens long, hot array<long>, n array<long>"))
    totals = vocabulary.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    if not totals["tokens"]:
        return Model(folder, 0, bits, order)
    shards = max(1, -(-totals["tokens"] * order // (2 * per_shard)))
    often = max(1, totals["tokens"] // (8 * shards))
    candidates = vocabulary.select(F.explode(F.arrays_zip("hot", "n")).alias("x")).where(F.col("x.n") > often).select("x.hot").collect()
    begin = short(BEGIN)
    hot = np.unique(np.array([int(begin), *(r["hot"] for r in candidates)], np.uint64))

    def grams(stream, first):
        columns, n = grams_of(stream, first, order)
        a, b, last = columns[0], columns[1], columns[-1]
        shard = pair_shard(a, np.where(a == begin, last, b), hot, shards)
        for s, (a, *rest, n) in _slices(a, shard, *columns[1:], n):
            yield s, encoded([a, *rest], n)

    def add_grams(group: pa.Table) -> pa.Table:
        """A shard's grams of all orders, from the highest to pairs; those of three words or more and the contexts of
        these are written, contexts with one gram of count one left out: the grams one order below tell of them."""
        s = group.column("shard")[0].as_py()
        each = [decoded([x.as_buffer() for x in row]) for row in group.column("parts")]
        columns = [np.concatenate([c[i] for c, _ in each]) for i in (*range(order - 2, -1, -1), order - 1)]
        n = np.concatenate([x for _, x in each])
        del each
        rows = []
        for k in range(order, 1, -1):
            key = gram_key(columns)
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(n[by_key], new)
            key, by_key = key[new], by_key[new]
            columns = [c[by_key] for c in columns]
            if k == 2:
                break
            shorter = (columns[0] == begin) & (columns[1] == begin)  # a gram at the start of a text, of fewer words
            real = np.flatnonzero(~shorter)
            _write_counts(folder, f"grams{k}-{s}", key[real], n[real], 48)
            context, *stats = _context_stats(gram_key([c[real] for c in columns[:-1]]), n[real])
            kept = np.flatnonzero((stats[0] > 1) | (stats[1] != 1))
            _write_counts(folder, f"context{k}-{s}", context[kept], np.stack([c[kept] for c in stats], 1), 48)
            rows.append((s % tables, 0, [np.array([-k, *_found(n[real])], np.int64)]))
            columns, n = columns[1:], np.where(shorter, n, 1)
        a, b = columns
        often = _is_hot(a, hot)
        for t, i in _by_table(b, bits, np.flatnonzero(often)):
            rows.append((t, 3, [a[i], b[i], n[i].astype(np.int64)]))
        own = np.flatnonzero(~often)
        a, b, n = a[own], b[own], n[own]
        _write_counts(folder, f"grams2-{s}", key[own], n, 48)
        rows.append((s % tables, 0, [np.array([-2, *_found(n)], np.int64)]))
        context, *stats = _context_stats(a, n)
        rows += [(t, 1, [context[i], *(c[i].astype(np.int64) for c in stats)]) for t, i in _by_table(context, bits)]
        after, times = counted(b, np.ones(len(b), np.int64))
        rows += [(t, 2, [after[i], times[i].astype(np.uint32)]) for t, i in _by_table(after, bits)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([[x.tobytes() for x in r[2]] for r in rows], pa.list_(pa.binary()))], ["table", "kind", "parts"])

    def table(group: pa.Table) -> pa.Table:
        """One table of words: continuations, context statistics and pairs that begin with hot words, written as
        sorted arrays. The rows, to be summed by id, are statistics of hot words, and below zero counts of counts."""
        t = group.column("table")[0].as_py()
        kind = group.column("kind").to_numpy()

        def of(k: int, *kinds: type) -> tuple[np.ndarray, ...]:
            return _merged(group.column("parts").filter(pa.array(kind == k)), kinds) if (kind == k).any() else tuple(np.zeros(0, x) for x in kinds)

        a, b, n = of(3, np.uint64, np.uint64, np.int64)
        key = chained(a, b)
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[by_key], new) if len(new) else n
        a, b = a[by_key[new]], b[by_key[new]]
        _write_counts(folder, f"hot-{t}", key[new], n, 48)
        after, times = of(2, np.uint64, np.uint32)
        follow, times = counted(np.concatenate([after, b]), np.concatenate([times.astype(np.int64), np.ones(len(b), np.int64)]))
        _write_counts(folder, f"follow-{t}", follow, times, 48)
        context, *stats = of(1, np.uint64, *[np.int64] * 4)
        by_key = np.argsort(context, kind="stable")
        _write_counts(folder, f"context-{t}", context[by_key], np.stack([c[by_key] for c in stats], 1), 48)
        out = [of(0, np.int64)[0].reshape(-1, 6), np.array([[-2, *_found(n)], [-1, *_found(times)[:4], int((times > 2).sum())]], np.int64)]
        word, *stats = _context_stats(a, n)
        out.append(np.stack([word.astype(np.int64), *stats, np.zeros(len(word), np.int64)], 1))
        return pa.table([pa.array(c) for c in np.concatenate(out).T.copy()], ["id", "n0", "n1", "n2", "n3", "n4"])

    made = _dealt(texts, grams, 12_000_000 // order).groupBy("shard").applyInArrow(add_grams, "table int, kind int, parts array<binary>")
    made = made.groupBy("table").applyInArrow(table, "id long, n0 long, n1 long, n2 long, n3 long, n4 long")
    sums = {r["id"]: r[1:] for r in made.groupBy("id").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(5))).collect()}
    discounts = tuple(Discounts.of(sums[-k][:4]) for k in range(1, order + 1))
    continuations = sums[-2][4]
    mass = discounts[0].mass(sums[-1][0], sums[-1][1], sums[-1][4]) / max(1, continuations)
    hot_stats = tuple(tuple(sums.get(int(h), (0,) * 5)[:4]) for h in hot)
    return Model(folder, shards, bits, order, tuple(int(h) for h in hot), hot_stats, totals["tokens"], totals["words"], continuations, discounts, mass)


def table_bits(n_texts: int, each: int = 50_000) -> int:
    """64 tables of words, more where there are many texts: a table has the words of about ``each`` texts at most."""
    return max(6, (-(-n_texts // each) - 1).bit_length()) if n_texts else 6


def _by_table(keys48: np.ndarray, bits: int, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Table numbers of 48-bit hashes (of ``rows``, or all) and the rows of each."""
    rows = np.arange(len(keys48)) if rows is None else rows
    t = _table_of(keys48[rows], bits)
    order = np.argsort(t, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0])) if len(t) else []
    for i, j in zip(cut, [*cut[1:], len(order)]):
        yield int(t[order[i]]), rows[order[i:j]]


def _table_of(keys48: np.ndarray, bits: int) -> np.ndarray:
    return (keys48 >> np.uint64(48 - bits)).astype(np.int64)


def pair_shard(a: np.ndarray, b: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of grams with ``a`` before their last word: by that word, by ``b`` too where it is hot."""
    return _shard_of(common.mix64(np.where(_is_hot(a, hot), a * _GOLDEN + b, a)), shards)


class Reader:
    """A model's files, mapped into memory as they are asked for."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}
        self.hot = np.array(model.hot, np.uint64)
        self.hot_stats = np.array(model.hot_stats, np.int64).reshape(-1, 4)

    def array(self, name: str, kind: type) -> np.ndarray:
        if name not in self.files:
            fs, path = common.open_fs(self.model.folder)
            path = f"{path}/{name}" if isinstance(fs, pafs.LocalFileSystem) else SparkFiles.get(f"{os.path.basename(self.model.folder)}-{name}")
            self.files[name] = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        return self.files[name]

    def lookup(self, stem: str, parts: np.ndarray, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """The counts of ``keys``, zero for absent ones; ``parts`` tells each key's file."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(parts, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(parts[order]) != 0])) if len(order) else []
        for i, j in zip(cut, [*cut[1:], len(order)]):
            rows = order[i:j]
            name = f"{stem}-{parts[rows[0]]}"
            have, rest = self.array(f"{name}.key", np.uint64), self.array(f"{name}.rest", np.uint32)
            if len(rest):
                at = place_of(keys[rows], self.array(f"{name}.first", np.uint32), rest)
                hit = at >= 0
            elif len(have):
                at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                hit = have[at] == keys[rows]
            else:
                continue
            at = at[hit]
            found = self.array(f"{name}.count", np.uint8).reshape(-1, width)[at].astype(np.int64)
            top = np.flatnonzero((found == LARGE).any(1))
            if len(top):
                large = self.array(f"{name}.large", np.int64)
                n = len(large) // (1 + width)
                found[top] = large[n:].reshape(n, width)[np.searchsorted(large[:n], at[top])]
            out[rows[hit]] = found
        return out

    def counts(self, stem: str, parts: np.ndarray, keys: np.ndarray, rows: np.ndarray, width: int = 1) -> np.ndarray:
        """``lookup`` of the keys in ``rows``, each distinct one once."""
        some, where, back = np.unique(keys[rows], return_index=True, return_inverse=True)
        return self.lookup(stem, parts[rows[where]], some, width)[back]

    def scores(self, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, the base's log10 probability, the model's."""
        m = self.model
        texts = len(first) - 1
        if not m.tokens:
            return np.zeros(texts, np.int64), np.zeros(texts), np.zeros(texts)
        words, place = np.unique(stream, return_inverse=True)
        count = self.lookup("words", (words >> np.uint64(64 - m.bits)).astype(np.int64), words)[:, 0]
        s = short(words)
        times = self.lookup("follow", _table_of(s, m.bits), s)[:, 0]
        single = np.maximum(times - m.discounts[0](times), 0) / max(1, m.continuations) + m.single_mass / (m.words + 1)
        known = (count > 0)[place]
        # the texts with a BEGIN each: where tokens stand there, and how many tokens and BEGIN are before them
        at = np.arange(len(stream)) + np.repeat(np.arange(1, texts + 1), np.diff(first))
        depth = np.arange(1, len(stream) + 1) - np.repeat(first[:-1], np.diff(first))
        line = np.full(len(stream) + texts, short(BEGIN))
        line[at] = short(stream)
        before = line[at - 1]
        shard = pair_shard(before, line[np.maximum(at - 2, 0)], self.hot, m.shards)
        often = _is_hot(before, self.hot)
        p, key, seen = single[place], line, np.zeros(len(line), np.int64)
        for k in range(2, m.order + 1):
            context = key[at - 1]
            key = np.concatenate([key[:1], chained(key[:-1], line[1:])])
            gram = key[at]
            stats, c = np.zeros((len(stream), 4), np.int64), np.zeros(len(stream), np.int64)
            if k == 2:
                stats[often] = self.hot_stats[np.searchsorted(self.hot, before[often])]
                rows = np.flatnonzero(~often)
                stats[rows] = self.counts("context", _table_of(before, m.bits), before, rows, 4)
                rows = np.flatnonzero(often & known)
                c[rows] = self.counts("hot", _table_of(line[at], m.bits), gram, rows)[:, 0]
                rows = np.flatnonzero(~often & known & (stats[:, 0] > 0))
            else:
                rows = np.flatnonzero((depth >= k - 1) & (seen[at - 1] > 0))
                stats[rows] = self.counts(f"context{k}", shard, context, rows, 4)
                stats[rows[stats[rows, 0] == 0]] = (1, 1, 0, 0)  # was met and is not in the file
                rows = np.flatnonzero((stats[:, 0] > 0) & (seen[at] > 0))
            c[rows] = self.counts(f"grams{k}", shard, gram, rows)[:, 0]
            d = m.discounts[k - 1]
            total, n1, n2, n3 = stats.T
            left = np.where(total > 0, d.mass(n1, n2, n3) / np.maximum(total, 1), 1.0)
            p = np.maximum(c - d(c), 0) / np.maximum(total, 1) + left * p
            seen = np.zeros(len(line), np.int64)
            seen[at] = c
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))[place]
        begin = first[:-1]
        return np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model, modulus: int = 5, rest: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    spark = docs.sparkSession
    fs, path = common.open_fs(model.folder)
    if model.tokens and not isinstance(fs, pafs.LocalFileSystem):  # workers can't map a remote file: Spark brings it to their disks
        for info in fs.get_file_info(pafs.FileSelector(path)):
            spark.sparkContext.addFile(f"{model.folder}/{info.base_name}")
    sent = spark.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        if m.folder not in _readers:
            _readers.clear()
            _readers[m.folder] = Reader(m)
        stream, first = tokens(batch)
        known, base, own = _readers[m.folder].scores(stream, first)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first), pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(batch.num_rows, m.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", modulus, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, step, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_all(docs: DataFrame, modulus: int = 5, rest: int = 1, order: int = 2) -> DataFrame:
    """Learns from the rows that are not held out and scores all rows."""
    training = docs.where(~common.held_out("doc_id", modulus, rest)).select(F.col("text").cast("string").alias("text"))
    with common.stepwise(docs.sparkSession):
        model = fit(training, training.count(), common.shared_folder(docs.sparkSession), order=order)
    return score(docs, model, modulus, rest)
