"""The cross-feature language and the set of queries that a specification stands for. Metadata only, no data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the second id in a hashed pair.
HASH_STEP = 7907


def parse_pairs(spec: str, features: list[str]) -> list[tuple[str, str]]:
    """Terms are separated by ``|``; a term is features joined by ``&``; ``*`` stands for any feature. A term's
    combinations become sets of names, of which those with exactly two names stay, sorted, each once, in the order of
    their first appearance. An unknown name raises."""
    found: dict[tuple[str, str], None] = {}
    for term in filter(None, (t.strip() for t in spec.split("|"))):
        combos: list[frozenset[str]] = [frozenset()]
        for part in (p.strip() for p in term.split("&")):
            if part != "*" and part not in features:
                raise ValueError(f"unknown feature {part!r} in {spec!r}")
            combos = [c | {f} for c in combos for f in (features if part == "*" else [part])]
        for combo in combos:
            if len(combo) == 2:
                found.setdefault(tuple(sorted(combo)), None)  # type: ignore[arg-type]
    return list(found)


@dataclass(frozen=True)
class Single:
    """One feature's cells: its id, or its id modulo a smaller size."""

    feature: str
    size: int

    @property
    def name(self) -> str:
        return self.feature

    @property
    def features(self) -> tuple[str, ...]:
        return (self.feature,)

    def cell(self, ids: Mapping[str, Column]) -> Column:
        return F.pmod(ids[self.feature].cast("long"), F.lit(self.size)).cast("int")

    def sql(self, ids: Mapping[str, str]) -> str:
        return f"CAST({ids[self.feature]} % {self.size} AS INTEGER)"


@dataclass(frozen=True)
class Pair:
    """Two features' cells: id1 + size1 * id2 where all combinations fit in the size, else a hash modulo the size."""

    first: str
    second: str
    step: int
    size: int
    hashed: bool

    @property
    def name(self) -> str:
        return f"{self.first}&{self.second}"

    @property
    def features(self) -> tuple[str, ...]:
        return (self.first, self.second)

    def cell(self, ids: Mapping[str, Column]) -> Column:
        return F.pmod(ids[self.first].cast("long") + F.lit(self.step) * ids[self.second].cast("long"), F.lit(self.size)).cast("int")

    def sql(self, ids: Mapping[str, str]) -> str:
        return f"CAST(({ids[self.first]} + {self.step} * {ids[self.second]}) % {self.size} AS INTEGER)"

    def split(self, cell: Column) -> tuple[Column, Column]:
        """The two ids of a cell; a hashed pair has no way back."""
        if self.hashed:
            raise ValueError(f"{self.name} is hashed: its cells can't be decoded")
        return F.pmod(cell, F.lit(self.step)).cast("int"), F.floor(cell / F.lit(self.step)).cast("int")


@dataclass(frozen=True)
class QuerySet:
    """Singles first, then pairs; immutable, so models over different parts of the features never share state."""

    features: tuple[str, ...]
    sizes: Mapping[str, int]
    queries: tuple[Single | Pair, ...] = field(default=())

    @staticmethod
    def build(sizes: Mapping[str, int], spec: str = "*&*", caps: int | Mapping[str, int] | None = None) -> QuerySet:
        """``sizes``: ids of each feature, unknown included. ``caps``: the most cells of a query, for all or by query
        name, with "default" for the rest."""
        features = list(sizes)

        def cap(name: str) -> int | None:
            return caps if isinstance(caps, int) or caps is None else caps.get(name, caps.get("default"))

        own = {f: min(sizes[f], cap(f) or sizes[f]) for f in features}
        queries: list[Single | Pair] = [Single(f, own[f]) for f in features]
        for a, b in parse_pairs(spec, features):
            most, exact = cap(f"{a}&{b}"), own[a] * own[b]
            hashed = most is not None and exact > most
            queries.append(Pair(a, b, HASH_STEP if hashed else own[a], most if hashed else exact, hashed))  # type: ignore[arg-type]
        return QuerySet(tuple(features), own, tuple(queries))

    def restricted(self, spec: str) -> QuerySet:
        """The singles, and of the pairs those that ``spec`` names."""
        wanted = set(parse_pairs(spec, list(self.features)))
        return QuerySet(self.features, self.sizes, tuple(q for q in self.queries if isinstance(q, Single) or (q.first, q.second) in wanted))

    def named(self, name: str) -> Single | Pair:
        return next(q for q in self.queries if q.name == name)

    @property
    def names(self) -> list[str]:
        return [q.name for q in self.queries]

    @property
    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for q in self.queries:
            out[q.name] = at
            at += q.size
        return out

    @property
    def total(self) -> int:
        return sum(q.size for q in self.queries)
