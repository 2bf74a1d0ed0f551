"""Transducers over characters, their composition with a text, and shortest paths in the tropical semiring.

A subsequential transducer has one path for each text: composing it with a text is running it. A weighted machine of
pieces and a grammar over pieces are composed with a text as the search asks for their arcs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heappop, heappush


@dataclass
class Subsequential:
    """States are numbers, the first is 0. An arc reads a character and writes a string; a character without an arc of
    its own takes the state's other arc, which writes a string and then the character. A text's end writes ``final``."""

    arcs: list[dict[str, tuple[int, str]]]
    other: list[tuple[int, str]]
    final: list[str]

    def run(self, text: str) -> str:
        state, out = 0, []
        for char in text:
            arc = self.arcs[state].get(char)
            if arc is None:
                state, written = self.other[state]
                out += (written, char)
            else:
                state, written = arc
                out.append(written)
        out.append(self.final[state])
        return "".join(out)


@dataclass
class Rewriting:
    """The transducer of rewriting rules: from left to right the longest left side that fits is read and its right side
    written, else one character is copied. Its states are the beginnings of left sides."""

    rules: dict[str, str]
    begins: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.begins = frozenset(left[:n] for left in self.rules for n in range(1, len(left) + 1))

    def run(self, text: str) -> str:
        if not self.rules or self.begins.isdisjoint(text):
            return text
        out, at = [], 0
        while at < len(text):
            end, longest = at + 1, 0
            while end <= len(text) and text[at:end] in self.begins:
                if text[at:end] in self.rules:
                    longest = end
                end += 1
            out.append(self.rules[text[at:longest]] if longest else text[at])
            at = longest or at + 1
        return "".join(out)


@dataclass
class Pieces:
    """The transducer that reads a piece's characters and writes its id: a trie whose accepting states lead back to the
    first one, with the piece's weight. A character that is no piece takes a fallback arc, which writes other ids."""

    weights: dict[str, tuple[int, int]]  # by text: id and weight
    fallback: Callable[[str], tuple[int, ...]]
    fallback_weight: int = 0
    trie: dict[str, tuple[int, int] | None] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.trie = {text[:n]: self.weights.get(text[:n]) for text in self.weights for n in range(1, len(text) + 1)}
        self.longest = max(map(len, self.weights), default=1)


#: The grammar's state before the first piece and after a fallback.
NONE = -1


def shortest_path(text: str, pieces: Pieces, follows: Callable[[int, int], bool] | None) -> list[int]:
    """The ids written by the shortest path of text o pieces o grammar. Weights are not below zero.

    States are places in the text and, with a grammar, the last piece: an arc to a piece that may not follow the last
    one weighs infinity. Without a grammar there is one state for each place. States are settled in order of their
    distance from the start, of equal ones the one farthest in the text first; a weight of the grammar is looked up
    when its arc is taken, so most are never asked for. Of equally short paths the one with the longer last piece is
    taken. Weights are whole numbers, so that equal sums are equal in any order."""
    size, get, longest = len(text), pieces.trie.get, pieces.longest
    ahead: list[tuple] = []
    settled = set()
    distance, place, last, trail, serial = 0, 0, NONE, None, 0
    while place < size:
        end, stop, single = place + 1, min(place + longest, size), False
        while end <= stop:
            part = text[place:end]
            if part not in pieces.trie:
                break
            arc = get(part)
            if arc is not None:
                serial += 1
                single = single or end == place + 1
                heappush(ahead, (distance + arc[1], -end, place, serial, arc[0], last, (trail, (arc[0],))))
            end += 1
        if not single:
            serial += 1
            heappush(ahead, (distance + pieces.fallback_weight, -place - 1, place, serial, NONE, NONE, (trail, pieces.fallback(text[place]))))
        while True:
            distance, end, _, _, piece, before, trail = heappop(ahead)
            state = (end, piece if follows else NONE)
            if state not in settled and (follows is None or piece < 0 or follows(before, piece)):
                break
        settled.add(state)
        place, last = -end, piece
    out: list[tuple[int, ...]] = []
    while trail:
        trail, ids = trail
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]
