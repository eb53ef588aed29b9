"""watch: the change of a plan over an interval of editions.

Linear nodes pass changes through; a join changes by dA x B(from) + A(to) x dB; distinct and reduce look again
only at the rows and groups that the change touches, at both ends; a recursion is recomputed at both ends.  A
plan none of whose relations was touched has no change, which the manifest tells without a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import META, TraceStore
from . import ir
from .find import W, Snapshot, Weighted, evaluate, join, reduce


class Interval:
    """The editions (lo, hi] of a store."""

    def __init__(self, store: TraceStore, lo: int, hi: int | None = None):
        self.store, self.lo, self.hi = store, lo, store.current if hi is None else hi
        if self.lo > self.hi:
            raise ValueError("an interval runs backwards")
        self.before, self.after = Snapshot(store, self.lo), Snapshot(store, self.hi)

    def quiet(self, plan: ir.Plan) -> bool:
        return not any(self.store.touched_since(n, self.lo, self.hi) for n in ir.base_relations(plan))

    def relation(self, name: str) -> Weighted:
        log = self.store.log(name, self.lo, self.hi)
        cols = [c for c in log.columns if c not in META]
        types = self.after.relation(name).types
        return Weighted(log.select(*cols, F.col("__diff").alias(W)), types, self.store.positive(name, self.hi))

    def delta(self, plan: ir.Plan, names: list[str] | None = None) -> DataFrame:
        """Consolidated signed rows: named columns and __diff."""
        w = evaluate_delta(plan, self).consolidated()
        return w.df.select(*[F.col(c).alias(n) for c, n in zip(w.cols, names or w.cols, strict=True)], F.col(W).alias("__diff"))


def _empty_like(w: Weighted) -> Weighted:
    return Weighted(w.df.where(F.lit(False)), w.types, True)


def _only(w: Weighted, keys: DataFrame, cols: list[str]) -> Weighted:
    return Weighted(w.df.join(keys, cols, "left_semi") if cols else w.df, w.types, w.positive, w.unit)


def evaluate_delta(plan: ir.Plan, span: Interval) -> Weighted:
    ev = lambda p: evaluate_delta(p, span)
    if span.quiet(plan):
        return _empty_like(evaluate(plan, span.after)) if not isinstance(plan, ir.Iterate) else _empty_like(evaluate(plan.init, span.after))
    if isinstance(plan, ir.Rel):
        return span.relation(plan.name)
    if isinstance(plan, (ir.Range, ir.RangeOn)):
        own = Snapshot(span.store, span.hi, {plan.name: span.relation(plan.name)})
        return evaluate(plan, own)
    if isinstance(plan, (ir.Map, ir.Filter, ir.Project)):
        return _linear(plan, ev(plan.input), span)
    if isinstance(plan, ir.Union):
        return ev(plan.left).union(ev(plan.right))
    if isinstance(plan, ir.Negate):
        return ev(plan.input).negated()
    if isinstance(plan, ir.Shared):
        return ev(plan.input)
    if isinstance(plan, ir.Join):
        parts = []
        if not span.quiet(plan.left):
            parts.append(join(ev(plan.left), evaluate(plan.right, span.before), plan.left_keys, plan.right_keys))
        if not span.quiet(plan.right):
            parts.append(join(evaluate(plan.left, span.after), ev(plan.right), plan.left_keys, plan.right_keys))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if isinstance(plan, ir.Distinct):
        change = ev(plan.input).consolidated()
        old = evaluate(plan.input, span.before)
        touched = _only(old, change.df.select(*change.cols), change.cols)
        both = touched.df.select(*old.cols, F.col(W).alias("a"), F.lit(0).cast("long").alias("d")).unionByName(change.df.select(*old.cols, F.lit(0).cast("long").alias("a"), F.col(W).alias("d")))
        at = both.groupBy(*old.cols).agg(F.sum("a").alias("a"), F.sum(F.col("a") + F.col("d")).alias("b")) if old.cols else both.agg(F.sum("a").alias("a"), F.sum(F.col("a") + F.col("d")).alias("b"))
        sign = (F.col("b") > 0).cast("long") - (F.col("a") > 0).cast("long")
        return Weighted(at.select(*old.cols, sign.alias(W)).where(f"{W} <> 0"), old.types)
    if isinstance(plan, ir.Reduce):
        change = ev(plan.input).consolidated()
        cols = [f"c{k}" for k in plan.keys]
        groups = change.df.select(*cols).distinct() if cols else change.df
        ends = [reduce(_only(evaluate(plan.input, s), groups, cols), plan.keys, plan.agg) for s in (span.after, span.before)]
        return ends[0].union(ends[1].negated())
    if isinstance(plan, ir.Iterate):
        return evaluate(plan, span.after).union(evaluate(plan, span.before).negated())
    raise TypeError(f"no plan: {plan!r}")


def _linear(plan: ir.Plan, change: Weighted, span: Interval) -> Weighted:
    """A node applied to the change of its input."""
    from dataclasses import replace

    own = Snapshot(span.store, span.hi, {"\x00change": change})
    return evaluate(replace(plan, input=ir.Rel("\x00change")), own)


class DeltaStream:
    """First the rows at registration, then what changed since the last poll; their sum is always the fresh answer."""

    def __init__(self, store: TraceStore, plan: ir.Plan, at: int | None = None):
        self.store, self.plan = store, plan
        self.cursor = store.current if at is None else at
        self.started = False

    def poll(self) -> list[tuple[tuple, int]]:
        """Signed rows on the driver, sorted; empty if nothing changed."""
        from ..types import from_cell
        from .local import consolidate

        if not self.started:
            self.started = True
            return Snapshot(self.store, self.cursor).rows(self.plan)
        lo, hi = self.cursor, self.store.current
        self.cursor = hi
        if lo == hi:
            return []
        span = Interval(self.store, lo, hi)
        if span.quiet(self.plan):
            return []
        w = evaluate_delta(self.plan, span).consolidated()
        return consolidate((tuple(from_cell(r[c], t) for c, t in zip(w.cols, w.types, strict=True)), r[W]) for r in w.df.toLocalIterator())
