"""Patterns over ordered input, and parses maintained as the input changes.

A pattern relates a place in an ordered input to bindings and the places after what it consumed.  Inputs are
rows, nested tuples, bytes and signed updates.  ``form_columns`` turns patterns of literals and bindings (all
that the text language writes) into plain column expressions; ``parser_udtf`` runs the others in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ir import Ctor
from ..plans.local import consolidate
from ..types import key, row_key

# --------------------------------------------------------------------------- inputs


def over_row(row: Sequence) -> list:
    return list(row)


def over_ast(value: object) -> list | None:
    """The children of a tuple; a leaf has none."""
    return list(value) if isinstance(value, tuple) else None


def over_bytes(data: bytes) -> list[int]:
    return list(data)


def over_updates(updates: Sequence[tuple[int, tuple, int]]) -> list[tuple]:
    """(edition, row, diff) as (sign, row, edition)."""
    return [((d > 0) - (d < 0), row, e) for e, row, d in updates]


# --------------------------------------------------------------------------- patterns


class Pattern:
    def parses(self, items: list, at: int, bound: dict) -> Iterator[tuple[int, dict]]:
        raise NotImplementedError


@dataclass(frozen=True)
class Lit(Pattern):
    value: object

    def parses(self, items, at, bound):
        if at < len(items) and key(items[at]) == key(self.value):
            yield at + 1, bound


@dataclass(frozen=True)
class Bind(Pattern):
    name: str

    def parses(self, items, at, bound):
        if at < len(items):
            yield at + 1, {**bound, self.name: items[at]}  # of two captures of a name the last stays


@dataclass(frozen=True)
class Seq(Pattern):
    parts: tuple = ()

    def parses(self, items, at, bound):
        if not self.parts:
            yield at, bound
            return
        rest = Seq(self.parts[1:])
        for mid, b in self.parts[0].parses(items, at, bound):
            yield from rest.parses(items, mid, b)


@dataclass(frozen=True)
class Choice(Pattern):
    parts: tuple = ()

    def parses(self, items, at, bound):
        for p in self.parts:
            yield from p.parses(items, at, bound)


@dataclass(frozen=True)
class Repeat(Pattern):
    """0 or more times, every count; a step that consumes nothing ends it."""

    part: Pattern

    def parses(self, items, at, bound):
        level = [(at, bound)]
        while level:
            yield from level
            level = [(to, b) for start, own in level for to, b in self.part.parses(items, start, own) if to > start]


@dataclass(frozen=True)
class Guard(Pattern):
    part: Pattern
    test: Callable[[dict], bool]

    def parses(self, items, at, bound):
        for to, b in self.part.parses(items, at, bound):
            if self.test(b):
                yield to, b


@dataclass(frozen=True)
class Rule:
    pattern: Pattern
    make: Ctor | Callable[[dict], object]

    def build(self, bound: dict) -> object:
        return self.make.build(bound) if isinstance(self.make, Ctor) else self.make(bound)


@dataclass(frozen=True)
class Form:
    rules: tuple[Rule, ...]

    def parse(self, items: list, at: int = 0) -> list[tuple[object, int]]:
        """All parses from a place: (value, place after)."""
        return [(r.build(b), to) for r in self.rules for to, b in r.pattern.parses(items, at, {})]

    def parse_all(self, items: list) -> list[object]:
        """The values of parses that consume all of the input."""
        return [v for v, to in self.parse(items) if to == len(items)]

    def print(self, value: tuple) -> list | None:
        """The tokens that parse to value, if exactly one invertible rule writes it."""
        outs = []
        for r in self.rules:
            bound = r.make.unbuild(value) if isinstance(r.make, Ctor) else None
            if bound is not None:
                parts = r.pattern.parts if isinstance(r.pattern, Seq) else (r.pattern,)
                outs.append([p.value if isinstance(p, Lit) else bound.get(p.name, "") for p in parts])
        if len(outs) > 1:
            raise ValueError(f"{value!r} is written by {len(outs)} rules")
        return outs[0] if outs else None


# --------------------------------------------------------------------------- in Spark


def form_columns(form: Form, tokens: Column, width: int) -> Column:
    """The first full parse of an array of words as array(tag, arguments.., padded with nulls), or null.

    For rules of literals and bindings: a test of the number of words and of the literals, no Python.
    """
    out = F.lit(None).cast("array<string>")
    for r in reversed(form.rules):
        parts = r.pattern.parts if isinstance(r.pattern, Seq) else (r.pattern,)
        ok = F.size(tokens) == len(parts)
        slots: dict[str, int] = {}
        for i, p in enumerate(parts):
            if isinstance(p, Lit):
                ok = ok & (F.get(tokens, F.lit(i)) == F.lit(p.value))
            else:
                slots[p.name] = i
        args = [F.get(tokens, F.lit(slots[a])) if a in slots else F.lit("") for a in r.make.args]
        pad = [F.lit(None).cast("string")] * (width - 1 - len(args))
        out = F.when(ok, F.array(F.lit(r.make.tag), *args, *pad)).otherwise(out)
    return out


def parser_udtf(form: Form, schema: str = "tag string, args array<string>, rest int"):
    """A Python UDTF: all parses of an array of words."""

    @F.udtf(returnType=schema)
    class Parse:
        def eval(self, tokens):
            for value, to in form.parse(list(tokens or [])):
                yield value[0], [str(v) for v in value[1:]], len(tokens) - to

    return Parse


# --------------------------------------------------------------------------- maintained parses


class ParseStream:
    """Parses over a window of a relation whose far end only moves on: first all of them, then their changes."""

    def __init__(self, form: Form, contents: Callable[[int, int], list], lo: int, hi: int):
        self.form, self.contents, self.lo, self.hi = form, contents, lo, hi
        self.now: dict | None = None
        self.runs = 0

    def _parse(self) -> dict:
        self.runs += 1
        out: dict = {}
        for v in self.form.parse_all(self.contents(self.lo, self.hi)):
            out[key(v)] = v
        return out

    def advance(self, hi: int | None = None) -> list[tuple[object, int]]:
        """Signed values, sorted; the first call gives the parses at the start."""
        if hi is not None:
            if hi < self.hi:
                raise ValueError("the far end of a parse stream doesn't go back")
            self.hi = hi
        old, self.now = self.now or {}, self._parse()
        gone = [(old[k], -1) for k in old.keys() - self.now.keys()]
        new = [(self.now[k], 1) for k in self.now.keys() - old.keys()]
        return sorted(gone + new, key=lambda x: (key(x[0]), x[1]))


class DifferentialParser(ParseStream):
    """The same output; parses are remembered by (items they consumed, whether the input ended there)."""

    def __init__(self, form: Form, contents: Callable[[int, int], list], lo: int, hi: int):
        super().__init__(form, contents, lo, hi)
        self.memo: dict = {}

    def _parse(self) -> dict:
        items = self.contents(self.lo, self.hi)
        k = (row_key(tuple(items)), True)
        if k not in self.memo:
            self.runs += 1
            self.memo[k] = {key(v): v for v in self.form.parse_all(items)}
        return self.memo[k]


class StateSequence:
    """The window's net contents as an ordered sequence of rows, each as often as its weight."""

    def __init__(self, updates: Callable[[int, int], list], before: Callable[[int], list]):
        self.updates, self.before = updates, before

    def __call__(self, lo: int, hi: int) -> list:
        change = consolidate((row, d) for _, row, d in self.updates(lo, hi))
        old = {row_key(r): w for r, w in self.before(lo)}
        return [r for r, d in change for _ in range(max(0, old.get(row_key(r), 0) + d))]


class EventSequence:
    """The window's updates in commit order, as (sign, row, edition)."""

    def __init__(self, updates: Callable[[int, int], list]):
        self.updates = updates

    def __call__(self, lo: int, hi: int) -> list:
        return over_updates(self.updates(lo, hi))
