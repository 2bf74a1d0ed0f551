"""Toxicity by a weighted lexicon.

The lexicon's entries are word beginnings and whole words with weights. A text is folded first (letter case,
accents, look-alike letters, digits that stand for letters), then one pass of an Aho-Corasick automaton finds
all entries and exception phrases. The weights of the words hit, but for those inside an exception phrase, are
summed and divided by a power of the text's length; a logistic curve turns that into a score.

Weights are lower confidence bounds of log odds learned from labelled rows; `BASE_LEXICON` adds general insults
for which there are no labelled rows.

Defined results: null and empty texts have no hits and score as such; repeated rows score alike; a null doc_id
is scored and never held out; texts of any length are read whole; with no labelled rows of both kinds only the base
lexicon is used; where two entries begin a word the greater weight counts; further columns are left out.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: General insults; a label set usually holds stronger evidence, which then replaces these weights.
BASE_LEXICON = ("idiot", "stupid", "moron", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "retard", "degenerate", "vermin", "subhuman")
BASE_WEIGHT = 2.0
#: Phrases in which an entry's word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "loser bracket", "idiot proof", "idiot light", "stupid simple", "worthless check")

#: Letters and digits that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
#: Letters that one sign stands for: l and 1 and i are written for each other.
MERGED = {"l": "i"}
#: Signs that may stand inside a word without parting it.
INVISIBLE = "­​‌‍⁠﻿'’"


class _Fold(dict):
    """str.translate's table, made up as characters are met."""

    def __missing__(self, code: int):
        out = self._of(chr(code))
        self[code] = out
        return out

    @staticmethod
    def _of(char: str):
        if char in INVISIBLE or unicodedata.combining(char):
            return None
        parts = []
        for c in unicodedata.normalize("NFKD", char).lower():
            if unicodedata.combining(c):
                continue
            c = DIGITS.get(c) or LOOKALIKES.get(c) or c
            parts.append(MERGED.get(c, c) if c.isalpha() else " ")
        return "".join(parts) or None


FOLD = _Fold()


def fold(text: str) -> str:
    """Words of folded letters, each after one or more spaces, with spaces around the whole."""
    return f" {text.translate(FOLD)} "


@dataclass(frozen=True)
class ToxicityModel:
    """entries: (folded beginning of a word, or whole word if it ends in a space; weight)."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    centre: float
    slope: float
    length_power: float = 0.25
    threshold: float = 0.7

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, tuple[float, int]] = {}
        for entry, weight in self.entries:
            key = f" {entry}"
            found[key] = (max(weight, found.get(key, (0.0, 0))[0]), 0)
        for phrase in self.exceptions:
            key = f" {' '.join(fold(phrase).split())} "
            found[key] = (0.0, len(key))
        machine = ahocorasick.Automaton()
        for key, (weight, covers) in found.items():
            machine.add_word(key, (len(key), weight, covers))
        machine.make_automaton()
        return machine

    def strength(self, machine: ahocorasick.Automaton, text: str) -> tuple[float, int, int]:
        """The sum of the weights of the words hit, how many words that are, and how many words there are."""
        folded = fold(text)
        if "  " in folded:
            folded = f" {' '.join(folded.split())} "
        hits: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, weight, covers) in machine.iter(folded) if len(machine) else ():
            begin = end + 1 - size
            if covers:
                covered.append((begin, end))
            elif weight > hits.get(begin, 0.0):
                hits[begin] = weight
        for begin, end in covered:
            for at in [h for h in hits if begin <= h < end]:
                del hits[at]
        return sum(hits.values()), len(hits), folded.count(" ") - 1 if folded.strip() else 0

    def normalised(self, strength: float, words: int) -> float:
        return strength / max(1.0, words / 100) ** self.length_power

    def score(self, z: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * (z - self.centre) + math.log(self.threshold / (1 - self.threshold))))))


def _features(text: str, shortest: int = 4, longest: int = 6) -> set[str]:
    """Beginnings of 4 to 6 letters, and whole words (with a space at the end) of up to 24 letters."""
    out: set[str] = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            if len(word) <= 24:
                out.add(f"{word} ")
            out.update(word[:n] for n in range(shortest, min(longest, len(word)) + 1))
    return out


#: Independent hashes of a text's runs of five words, and how many of them near copies share at least.
HASHES, SHARED = 6, 2


def least_hashes(text: str) -> list[int]:
    """The smallest of each hash. Texts that have no more than some lines in common rarely share two of them."""
    words = text.lower().split()
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    h = common.mix64(np.array([zlib.crc32(r.encode()) for r in runs], np.uint64))
    return [int((common.mix64(h + np.uint64(k)) >> np.uint64(1)).min()) for k in range(HASHES)]


def training_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Labelled rows that are not held out (crc32 mod 3 is not 1), without near copies: a text goes that shares
    ``SHARED`` of its ``HASHES`` with the text of smallest id that has them."""
    rows = common.labelled_sample(docs, labels, "toxic", 3, 1, most)

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [least_hashes(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("text"), pa.array(keys, pa.list_(pa.int64())), batch.column("doc_id")], ["y", "text", "keys", "doc_id"])

    rows = common.checkpointed(common.map_arrow(rows, keyed, "y int, text string, keys array<long>, doc_id long"))
    each = rows.select("doc_id", "y", F.posexplode("keys").alias("k", "h"))
    first = each.groupBy("y", "k", "h").agg(F.min("doc_id").alias("first"))
    met = each.join(first, ["y", "k", "h"]).where("first < doc_id").groupBy("doc_id", "first").agg(F.count("*").alias("n"))
    near = met.where(F.col("n") >= SHARED).select("doc_id").distinct()  # of the sample, so no more than ``most``
    return common.checkpointed(rows.join(F.broadcast(near), "doc_id", "left_anti").select("y", "text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, least_hits: int = 3, sureness: float = 3.0, most_entries: int = 50_000) -> ToxicityModel:
    """A lexicon and a score from at most ``most`` labelled rows.

    An entry needs ``least_hits`` toxic texts and a log odds ratio that stays above 0.5 when ``sureness`` standard
    errors are taken off. ``most_entries`` bounds what is sent to the driver: entries are ranked by evidence, and
    the sample bounds how many there can be."""
    sample = training_sample(docs, labels, most)
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    entries = {"".join(fold(w).split()): BASE_WEIGHT for w in BASE_LEXICON}
    if toxic and clean:

        def counted(keep: frozenset[str] | None):
            def step(batches):
                n: Counter[str] = Counter()
                for batch in batches:
                    for text in batch.column("text").to_pylist():
                        found = _features(text)
                        n.update(found if keep is None else found & keep)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])

            return step

        def totals(y: int, keep=None) -> DataFrame:
            return sample.where(F.col("y") == y).mapInArrow(counted(keep), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

        often = {r["entry"]: r["n"] for r in totals(1).where(F.col("n") >= least_hits).orderBy(F.desc("n"), "entry").limit(most_entries).collect()}
        rarely = {r["entry"]: r["n"] for r in totals(0, frozenset(often)).collect()}
        for entry, p in often.items():
            q = rarely.get(entry, 0)
            odds = math.log((p + 0.5) / (toxic - p + 0.5)) - math.log((q + 0.5) / (clean - q + 0.5))
            error = math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5) + 1 / (toxic - p + 0.5) + 1 / (clean - q + 0.5))
            if odds - sureness * error > 0.5:
                entries[entry] = round(odds - error, 4)
        for word in [w for w in map("".join, (fold(w).split() for w in BASE_LEXICON)) if entries[w] == BASE_WEIGHT and rarely.get(w, 0) > often.get(w, 0)]:
            del entries[word]
    model = ToxicityModel(tuple(sorted(entries.items())), EXCEPTIONS, 1.0, 1.0)
    if not (toxic and clean):
        return model
    return _calibrated(model, sample)


def _calibrated(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Where to put the curve: the cut of best F1 on the sample gets the threshold's score."""

    def strengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _machine(model)
        z = [model.normalised(*(lambda s: (s[0], s[2]))(model.strength(machine, t))) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(z, pa.float64())], ["y", "z"])

    rows: pd.DataFrame = common.map_arrow(sample, strengths, "y int, z double").toPandas()  # bounded by the sample
    z, y = rows["z"].to_numpy(), rows["y"].to_numpy()
    levels = np.unique(z)
    cuts = (levels[1:] + levels[:-1]) / 2
    if not len(cuts):
        return model
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order])
    marked = np.searchsorted(-z[order], -cuts, side="right")
    f1 = 2 * right[marked - 1] / (marked + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    centre = float(cuts[best[len(best) // 2]])
    spread = float(np.std(z)) or 1.0
    return ToxicityModel(model.entries, model.exceptions, centre, 4.0 / spread, model.length_power, model.threshold)


_machines: dict[ToxicityModel, ahocorasick.Automaton] = {}


def _machine(model: ToxicityModel) -> ahocorasick.Automaton:
    if model not in _machines:
        _machines.clear()
        _machines[model] = model.automaton()
    return _machines[model]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        machine = _machine(m)
        scores, hits = [], []
        for text in batch.column("text").to_pylist():
            strength, n, words = m.strength(machine, text or "")
            scores.append(m.score(m.normalised(strength, words)))
            hits.append(n)
        s = pa.array(scores, pa.float64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), s, pa.array([int(x >= m.threshold) for x in scores], pa.int32()), pa.array(hits, pa.int32())],
            ["doc_id", "held_out", "score", "predicted", "n_hits"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, step, "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        m = sent.value
        machine = _machine(m)
        found = (m.strength(machine, t or "") for t in texts.to_pylist())
        return np.array([m.score(m.normalised(s, words)) < m.threshold for s, _, words in found], bool)

    return common.keep_rows(docs, keep)
