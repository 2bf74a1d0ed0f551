"""SentencePiece encoding and decoding by weighted transducers.

The model file is compiled into transducers over characters (see ``transducer``): the normaliser, which is the model's
rewriting rules and a machine that turns white space into piece marks; the pieces, a trie that writes ids, with byte
fallback for a character that is no piece; and a grammar over pieces. For a unigram model an arc of a piece weighs
minus its score and any piece may follow any other. For a BPE model the grammar's states are the last piece, and an arc
leads on with weight zero only if merging the two pieces' characters in order of rank gives back just these two, else
it weighs infinity: in a sequence all of whose neighbours pass, merging never crosses a border, so exactly one path has
a finite weight, the one that merging the whole text gives.

Encoding composes the machines with a text and takes the shortest path in the tropical semiring. Where no piece holds
a newline, or a mark but at its beginning, the composition falls apart into chunks there; paths of chunks are
remembered within a bound. With other models the text is one chunk.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; repeated rows and rows with
a null id come out once for each row; further columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, transducer

#: Fixed values of the model format: kinds of pieces, kinds of models, the mark for white space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def rules_of(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled character map: a double array of bytes whose values point to right sides.

    All of the array's states are gone through level by level."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, right = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    states, lefts, rules = np.zeros(1, np.int64), [b""], {}
    signs = np.arange(1, 256)
    while len(states):
        after = states[:, None] ^ offset[states][:, None] ^ signs
        inside = after < len(units)
        at = np.where(inside, after, 0)
        hit = inside & ((units[at] & (1 << 31 | 255)) == signs)
        rows, columns = np.nonzero(hit)
        lefts = [lefts[r] + bytes([c + 1]) for r, c in zip(rows, columns)]
        states = at[hit]
        for left, state in zip(lefts, states):
            if units[state] >> 8 & 1:
                begin = int(units[state ^ offset[state]] & 0x7FFFFFFF)
                rules[left.decode("utf-8", "replace")] = right[begin : right.index(b"\0", begin)].decode("utf-8", "replace")
    return rules


def white_space(squeeze: bool) -> transducer.Subsequential:
    """Spaces to marks, of each run one or all; a run is written when it ends."""
    if not squeeze:
        return transducer.Subsequential([{" ": (0, MARK)}], [(0, "")], [""])
    return transducer.Subsequential([{" ": (1, "")}, {" ": (1, "")}], [(0, ""), (0, MARK)], ["", MARK])


@dataclass
class Machine:
    """The compiled model."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    prefix: bool
    squeeze: bool
    rules: dict[str, str] = field(default_factory=dict)
    most_remembered: int = 500_000
    paths: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[tuple[int, int], bool] = field(default_factory=dict)

    @classmethod
    def compile(cls, data: bytes) -> Machine:
        texts, scores, kinds, model, prefix, squeeze, rules = [], [], [], UNIGRAM, True, True, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                model = spec.get(3, UNIGRAM)
                if spec.get(24):
                    raise ValueError("models that put the mark after a word are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                if not spec.get(5, 1):
                    raise ValueError("models that keep spaces as they are are not supported")
                prefix, squeeze, rules = bool(spec.get(3, 1)), bool(spec.get(4, 1)), rules_of(spec.get(2, b""))
        if model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(texts, scores, kinds, model, prefix, squeeze, rules)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k in (NORMAL, USER)}
        by_byte = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.bytes_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else []
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        normal = [s for s, k in zip(self.scores, self.kinds) if k == NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        if self.model == UNIGRAM and most > 0:
            raise ValueError("scores of a unigram model are logarithms of probabilities")
        score = lambda i: -0.1 if self.kinds[i] == USER else self.scores[i]  # noqa: E731  the user's pieces go before others
        weight = lambda score: round(-score * (1 << 32)) if self.model == UNIGRAM else 0
        self.pieces = transducer.Pieces({t: (i, weight(score(i))) for t, i in self.ids.items()}, self.fallback, weight(least - 10.0))
        kept = {t: t for t, i in self.ids.items() if self.kinds[i] == USER}
        self.rewriting = transducer.Rewriting(self.rules | kept)
        self.white_space = white_space(self.squeeze)
        apart = not any(MARK in t.lstrip(MARK) or "\n" in t for t in self.ids)
        self.chunks = _CHUNK.findall if apart else lambda text: [text]

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_ids[b] for b in char.encode()) if self.bytes_ids else (self.unknown,)

    def merged(self, text: str) -> list[str]:
        """The text's symbols after all merges: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = (self.scores[found], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may stand after piece ``a``; below zero is the beginning or a fallback, which nothing merges with."""
        known = self.pairs.get((a, b))
        if known is None:
            left = self.texts[a] if a >= 0 else ""
            known = self.merged(left + self.texts[b]) == ([left] if left else []) + [self.texts[b]]
            if len(self.pairs) >= self.most_remembered:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def path(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit integers. Chunks met since the last time that the memory was full stay remembered."""
        out = self.older.get(chunk)
        if out is None:
            ids = transducer.shortest_path(self.white_space.run(chunk), self.pieces, self.follows if self.model == BPE else None)
            out = struct.pack(f"={len(ids)}i", *ids)
        if len(self.paths) >= self.most_remembered:
            self.older, self.paths = self.paths, {}
        if len(chunk) <= 64:
            self.paths[chunk] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        text = self.rewriting.run(text)
        if self.squeeze:
            text = text.lstrip(" ").rstrip(f" {MARK}")
        if not text:
            return np.zeros(0, np.int32)
        path = self.path
        ids = np.frombuffer(b"".join([self.paths.get(c) or path(c) for c in self.chunks(f" {text}" if self.prefix else text)]), np.int32)
        if self.bytes_ids:
            return ids
        unknown = ids == self.unknown  # a run of unknown characters is one piece
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: pieces joined, bytes put together, the mark before the text taken off."""
        out, raw = [], bytearray()
        first = {b: n for n, b in enumerate(self.bytes_ids)}
        for i in ids.tolist():
            if i in first:
                raw.append(first[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.kinds[i] != CONTROL:
                out.append(" ⁇ " if i == self.unknown else self.texts[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        text = text.lstrip(MARK) if self.squeeze else text.removeprefix(MARK) if self.prefix else text
        return text.replace(MARK, " ")


#: Where the composition falls apart: before the first of some marks, around newlines. A literal mark counts as a space.
_CHUNK = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")
_machines: dict[bytes, Machine] = {}


def _machine(data: bytes) -> Machine:
    if data not in _machines:
        _machines[data] = Machine.compile(data)
    return _machines[data]


def restores(text: str, machine: Machine, ids: np.ndarray) -> bool:
    """Whether decoding gives the text back; a literal mark comes back as a space."""
    return machine.decode(ids) == text.replace(MARK, " ")


def encode(docs: DataFrame, model_file: str, check: bool = True) -> DataFrame:
    """doc_id, ids, n_ids, restored: one row for each row of ``docs``; restored tells that decoding gave the text back.

    The model file is read on the driver (its size is fixed) and sent to the executors once."""
    with open(model_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _machine(sent.value)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [machine.encode(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        restored = pa.array([restores(t, machine, x) for t, x in zip(texts, ids)] if check else [None] * len(ids), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(offsets), pa.int32()), restored], ["doc_id", "ids", "n_ids", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, step, "doc_id long, ids array<int>, n_ids int, restored boolean", rows=512)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text: the texts of rows of doc_id and ids; null ids give an empty text."""
    with open(model_file, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _machine(sent.value)
        texts = [machine.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), step, "doc_id long, text string", rows=512)
