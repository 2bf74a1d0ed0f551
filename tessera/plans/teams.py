"""Teams of logical units. A unit is a value in a column, never a Spark partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce


def div_ceil(a: int, b: int) -> int:
    return -(-a // b)


def factorize(n: int) -> dict[int, int]:
    """Prime factors and how often each divides ``n``."""
    out: dict[int, int] = {}
    p = 2
    while p * p <= n:
        while n % p == 0:
            out[p] = out.get(p, 0) + 1
            n //= p
        p += 1
    if n > 1:
        out[n] = out.get(n, 0) + 1
    return out


def balance_extents(extents: tuple[int, ...]) -> tuple[int, ...]:
    """As many units, dealt to as many dimensions as evenly as their prime factors allow, largest first."""
    total = reduce(lambda a, b: a * b, extents, 1)
    out = [1] * len(extents)
    for prime, times in sorted(factorize(total).items(), reverse=True):
        for _ in range(times):
            at = min(range(len(out)), key=lambda d: out[d])
            out[at] *= prime
    return tuple(sorted(out, reverse=True))


@dataclass(frozen=True)
class TeamSpec:
    """A grid of units."""

    extents: tuple[int, ...]

    @property
    def size(self) -> int:
        return reduce(lambda a, b: a * b, self.extents, 1)

    def coords(self, unit: int) -> tuple[int, ...]:
        out = []
        for e in reversed(self.extents):
            out.append(unit % e)
            unit //= e
        return tuple(reversed(out))

    def unit(self, coords: tuple[int, ...]) -> int:
        out = 0
        for c, e in zip(coords, self.extents):
            out = out * e + c
        return out

    def neighbor(self, unit: int, offsets: tuple[int, ...]) -> int | None:
        """The unit at an offset, None beyond the grid."""
        at = tuple(c + o for c, o in zip(self.coords(unit), offsets))
        return self.unit(at) if all(0 <= c < e for c, e in zip(at, self.extents)) else None

    def periodic_neighbor(self, unit: int, offsets: tuple[int, ...]) -> int:
        return self.unit(tuple((c + o) % e for c, o, e in zip(self.coords(unit), offsets, self.extents)))


@dataclass(frozen=True)
class Team:
    """An ordered set of units and the team it was split from."""

    members: tuple[int, ...]
    position: int = 0
    parent: Team | None = field(default=None, compare=False)
    parts: int = field(default=0, compare=False)  # as how many its parent was split

    @classmethod
    def all(cls, size: int) -> Team:
        return cls(tuple(range(size)))

    @property
    def size(self) -> int:
        return len(self.members)

    def is_member(self, unit: int) -> bool:
        return unit in self.members

    def split(self, parts: int) -> list[Team]:
        """Contiguous groups of the size that would do for all; the last ones may be short or empty."""
        each = div_ceil(self.size, parts)
        return [Team(self.members[i * each : (i + 1) * each], i, self, parts) for i in range(parts)]

    def siblings(self) -> list[Team]:
        """The teams that its parent was split into, itself included; none of a team that was not split off."""
        return self.parent.split(self.parts) if self.parent else []

    def sibling(self, position: int) -> Team:
        return self.siblings()[position]

    def path(self) -> tuple[int, ...]:
        """Positions from the first team down to this one."""
        return (*self.parent.path(), self.position) if self.parent else ()

    def union(self, other: Team) -> Team:
        return Team(tuple(sorted({*self.members, *other.members})))

    def intersect(self, other: Team) -> Team:
        return Team(tuple(m for m in self.members if m in other.members))

    def add(self, unit: int) -> Team:
        return self.union(Team((unit,)))

    def remove(self, unit: int) -> Team:
        return Team(tuple(m for m in self.members if m != unit))


@dataclass(frozen=True)
class Domain:
    """A tree of units by where they are: a domain has a name, a scope (such as node or module), units and parts."""

    name: str
    scope: str
    units: tuple[int, ...] = ()
    parts: tuple[Domain, ...] = ()

    def all_units(self) -> tuple[int, ...]:
        return tuple(sorted({*self.units, *(u for p in self.parts for u in p.all_units())}))

    def walk(self) -> Iterator[Domain]:
        yield self
        for p in self.parts:
            yield from p.walk()

    def find(self, name: str) -> Domain:
        for d in self.walk():
            if d.name == name:
                return d
        raise KeyError(name)

    def scoped(self, scope: str) -> list[Domain]:
        """The domains of a scope, in order."""
        return [d for d in self.walk() if d.scope == scope]

    def _pruned(self, keep: Callable[[Domain], bool | None]) -> Domain | None:
        verdict = keep(self)
        if verdict is not None:
            return self if verdict else None
        parts = tuple(p for p in (part._pruned(keep) for part in self.parts) if p)
        return replace(self, parts=parts) if parts or self.units else None

    def select(self, names: set[str]) -> Domain | None:
        """The tree without what is neither in nor above one of the named domains."""
        return self._pruned(lambda d: True if d.name in names else None if d.parts else False)

    def exclude(self, names: set[str]) -> Domain | None:
        return self._pruned(lambda d: False if d.name in names else None if d.parts else True)

    def group(self, names: set[str], name: str) -> Domain:
        """The named parts of this domain put under one new domain in their first one's place."""
        members = tuple(p for p in self.parts if p.name in names)
        at = next(i for i, p in enumerate(self.parts) if p.name in names)
        rest = [p for p in self.parts if p.name not in names]
        rest.insert(sum(p.name not in names for p in self.parts[:at]), Domain(name, "group", (), members))
        return replace(self, parts=tuple(rest))

    def split(self, count: int, scope: str) -> list[Team]:
        """Teams of the units of as many consecutive domains of a scope each."""
        found = self.scoped(scope)
        each = div_ceil(len(found), count)
        chunks = [found[i * each : (i + 1) * each] for i in range(count)]
        return [Team(tuple(sorted(u for d in chunk for u in d.all_units())), i) for i, chunk in enumerate(chunks)]
