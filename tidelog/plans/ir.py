"""Query plans as data: fourteen node kinds, reified predicates and maps, and a builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import count

# --------------------------------------------------------------------------- expressions over one row


@dataclass(frozen=True)
class Col:
    i: int


@dataclass(frozen=True)
class Lit:
    value: object


RowExpr = Col | Lit


@dataclass(frozen=True)
class Eq:
    left: RowExpr
    right: RowExpr


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Closure:
    """A predicate or map that isn't reified: columns is a function of Spark columns, row of a Python row."""

    columns: Callable | None = None
    row: Callable | None = None
    arity: int | None = None


Pred = Eq | And | Closure

# --------------------------------------------------------------------------- plans

AGGREGATES = ("count", "sum", "min", "max")


@dataclass(frozen=True)
class Agg:
    kind: str
    col: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in AGGREGATES or (self.col is None) != (self.kind == "count"):
            raise ValueError(f"no such aggregate: {self.kind}({'' if self.col is None else self.col})")


_ids = count()


class Plan:
    """Base of all nodes; the methods build larger plans."""

    def filter(self, pred: Pred) -> Plan:
        return Filter(self, pred)

    def where_eq(self, col: int, value: object) -> Plan:
        return Filter(self, Eq(Col(col), Lit(value)))

    def map(self, *exprs: RowExpr) -> Plan:
        return Map(self, tuple(exprs))

    def map_with(self, fn: Closure) -> Plan:
        return Map(self, fn)

    def project(self, *cols: int) -> Plan:
        return Project(self, tuple(cols))

    def join(self, other: Plan, left: Sequence[int] = (), right: Sequence[int] = ()) -> Plan:
        if len(left) != len(right):
            raise ValueError("key lists of different lengths")
        return Join(self, other, tuple(left), tuple(right))

    def union(self, other: Plan) -> Plan:
        return Union(self, other)

    def negate(self) -> Plan:
        return Negate(self)

    def distinct(self) -> Plan:
        return Distinct(self)

    def reduce(self, keys: Sequence[int], agg: Agg) -> Plan:
        return Reduce(self, tuple(keys), agg)

    def iterate(self, step: Callable[[Plan], Plan]) -> Plan:
        """The least fixpoint of distinct(self + step(x)); step gets the recursion variable."""
        return Iterate(self, step(Recur()))

    def shared(self) -> Plan:
        return self if isinstance(self, Shared) else Shared(self)

    # derived operators
    def difference(self, other: Plan) -> Plan:
        return self.union(other.negate()).distinct()

    def union_distinct(self, other: Plan) -> Plan:
        return self.union(other).distinct()

    def intersect(self, other: Plan, arity: int) -> Plan:
        every = tuple(range(arity))
        return self.join(other, every, every).project(*every).distinct()

    def semi(self, other: Plan, left: Sequence[int], right: Sequence[int], arity: int) -> Plan:
        return self.join(other.project(*right).distinct(), left, range(len(right))).project(*range(arity)).distinct()

    def anti(self, other: Plan, left: Sequence[int], right: Sequence[int], arity: int) -> Plan:
        mine = self.shared()
        return mine.union(mine.semi(other, left, right, arity).negate()).distinct()


@dataclass(frozen=True)
class Rel(Plan):
    name: str


@dataclass(frozen=True)
class Range(Plan):
    """Rows of a relation in [lo, hi) by the row's own order; None leaves a side open."""

    name: str
    lo: tuple | None = None
    hi: tuple | None = None


@dataclass(frozen=True)
class RangeOn(Plan):
    """Rows whose column is in [lo, hi)."""

    name: str
    col: int
    lo: object = None
    hi: object = None


@dataclass(frozen=True)
class Map(Plan):
    input: Plan
    exprs: tuple | Closure


@dataclass(frozen=True)
class Filter(Plan):
    input: Plan
    pred: Pred


@dataclass(frozen=True)
class Project(Plan):
    input: Plan
    cols: tuple[int, ...]


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan
    left_keys: tuple[int, ...]
    right_keys: tuple[int, ...]


@dataclass(frozen=True)
class Union(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Negate(Plan):
    input: Plan


@dataclass(frozen=True)
class Distinct(Plan):
    input: Plan


@dataclass(frozen=True)
class Reduce(Plan):
    input: Plan
    keys: tuple[int, ...]
    agg: Agg


@dataclass(frozen=True)
class Iterate(Plan):
    init: Plan
    step: Plan


@dataclass(frozen=True)
class Recur(Plan):
    pass


@dataclass(frozen=True)
class Shared(Plan):
    """A sub-plan that is evaluated once per edition however often it is used."""

    input: Plan
    id: int = field(default_factory=lambda: next(_ids), compare=True)


def rel(name: str) -> Plan:
    return Rel(name)


def children(p: Plan) -> tuple[Plan, ...]:
    if isinstance(p, (Map, Filter, Project, Negate, Distinct, Reduce, Shared)):
        return (p.input,)
    if isinstance(p, (Join, Union)):
        return (p.left, p.right)
    return (p.init, p.step) if isinstance(p, Iterate) else ()


def walk(p: Plan) -> Iterator[Plan]:
    """All nodes, the plan itself first."""
    yield p
    for c in children(p):
        yield from walk(c)


def base_relations(p: Plan) -> set[str]:
    return {n.name for n in walk(p) if isinstance(n, (Rel, Range, RangeOn))}


def key_span(p: Plan) -> list[tuple[str, int, object, object]] | None:
    """(relation, column, lo, hi) of each base access, or None where one reads a whole relation: routing data of a watcher."""
    out = []
    for n in walk(p):
        if isinstance(n, Rel):
            return None
        if isinstance(n, Range):
            if not n.lo or not n.hi:
                return None
            out.append((n.name, 0, n.lo[0], n.hi[0]))
        if isinstance(n, RangeOn):
            out.append((n.name, n.col, n.lo, n.hi))
    return out


def recursion_uses(p: Plan) -> int:
    """The most recursion variables that one derivation of a step can use (1: linear)."""
    if isinstance(p, Recur):
        return 1
    if isinstance(p, Join):
        return recursion_uses(p.left) + recursion_uses(p.right)
    if isinstance(p, Iterate):
        return 0
    return max((recursion_uses(c) for c in children(p)), default=0)


def substitute(p: Plan, change: Callable[[Plan], Plan | None]) -> Plan:
    """p with the nodes for which change gives another in their place."""
    new = change(p)
    if new is not None:
        return new
    names = {"input", "left", "right", "init", "step"} & set(getattr(p, "__dataclass_fields__", {}))
    return replace(p, **{n: substitute(getattr(p, n), change) for n in names if isinstance(getattr(p, n), Plan)}) if names else p


# --------------------------------------------------------------------------- constructors


@dataclass(frozen=True)
class Ctor:
    """A tagged value: a Text tag and arguments that are slots of bound variables, by name."""

    tag: str
    args: tuple[str, ...] = ()

    def build(self, bound: dict[str, object]) -> tuple:
        return (self.tag, *[bound.get(a, "") for a in self.args])

    def invertible(self) -> bool:
        return len(set(self.args)) == len(self.args)

    def unbuild(self, value: tuple) -> dict[str, object] | None:
        """The bindings that build value, or None."""
        if not self.invertible() or len(value) != len(self.args) + 1 or value[0] != self.tag:
            return None
        return dict(zip(self.args, value[1:], strict=True))
