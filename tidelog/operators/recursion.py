"""Recursion: least fixpoints, and fixpoints maintained under insertion and deletion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans import ir
from ..plans.find import W, Snapshot, Weighted, evaluate, saved
from ..plans.local import check_step
from ..sources.storage import Buckets


def _monotone(p: ir.Plan) -> bool:
    return not any(isinstance(n, (ir.Negate, ir.Reduce)) for n in ir.walk(p))


def _minus(a: Weighted, b: Weighted) -> Weighted:
    """Rows of a (a set) that aren't in b."""
    return Weighted(a.df.join(b.df.select(*b.cols), a.cols, "left_anti").select(*a.cols, W), a.types, True, True)


def _both(a: Weighted, b: Weighted) -> Weighted:
    return Weighted(a.df.unionByName(b.df), a.types, True, True)


def fixpoint(plan: ir.Iterate, snap: Snapshot, most_rounds: int = 10_000) -> Weighted:
    """The least fixpoint of distinct(init + step(x)).

    Linear monotone steps go frontier by frontier (what is new since the last round); others recompute.  Each
    round's rows are written to the shared folder, so that plans don't grow with the rounds.
    """
    check_step(plan.step)
    init = evaluate(plan.init, snap)
    if _monotone(plan.step) and ir.recursion_uses(plan.step) <= 1:
        known = front = saved(init.distinct(), "fix")
        return grow(plan, snap, known, front, most_rounds)
    now = saved(init.distinct(), "fix")
    for _ in range(most_rounds):
        new = saved(init.union(evaluate(plan.step, snap, now)).distinct(), "fix")
        if _minus(new, now).df.isEmpty() and _minus(now, new).df.isEmpty():
            return new
        now = new
    raise RuntimeError("the recursion didn't end")


MANY = 2_000_000  # rows from which they are kept in buckets
ROWS = 250_000  # rows of a frontier to a bucket


def grow(plan: ir.Iterate, snap: Snapshot, known: Weighted, front: Weighted, most_rounds: int = 10_000) -> Weighted:
    """Semi-naive: derive from the frontier until nothing new comes."""
    n = known.df.count()
    for i in range(most_rounds):
        if n >= MANY and known.cols:
            return _grow_in_buckets(plan, snap, known, front, most_rounds - i)
        new = saved(_minus(evaluate(plan.step, snap, front).distinct(), known), "front")
        more = new.df.count()
        if more == 0:
            return known
        n += more
        known = _both(known, new)
        if i % 8 == 7:  # many small tables become one
            known = saved(known, "fix")
        front = new
    raise RuntimeError("the recursion didn't end")


def _grow_in_buckets(plan: ir.Iterate, snap: Snapshot, known: Weighted, front: Weighted, most_rounds: int) -> Weighted:
    """grow for many rows: what is known lies in buckets by row and is read where it is compared.

    A round shuffles the frontier to the rows that the step joins, which lie in buckets of their own, and what it derives
    to the buckets of the known rows, and writes what is new.  Known rows move only when frontiers have outgrown the buckets.
    """
    cols, spark = known.cols, known.df.sparkSession
    one = lambda df: Weighted(df.select(*cols, F.lit(1).cast("long").alias(W)), known.types, True, True)
    size, open_tables = front.df.count(), []
    try:
        for _ in range(most_rounds):
            wanted = max(spark.sparkContext.defaultParallelism, -(-size // ROWS))
            if not open_tables or wanted > 4 * open_tables[0].n:
                table = Buckets(spark, "fix", cols, wanted)
                old, open_tables = open_tables, [table, *open_tables]
                table.add(known.df.select(*cols).repartition(wanted, *cols))
                step, at = _with_fixed(plan.step, snap, wanted, open_tables)
                for x in old:
                    open_tables.remove(x)
                    x.close()
            w = evaluate(step, at, front)
            moved = w.df.select(*cols, *(() if w.positive else (W,))).repartition(table.n, *cols)
            derived = replace(w, df=moved).distinct().df.select(*cols)
            # the hash table is that of the derived rows, and the known ones stream by
            both = derived.hint("shuffle_hash").join(table.table().withColumn("__known", F.lit(True)), cols, "left")
            new = table.add(both.where("__known is null").select(*cols))
            known, size = one(table.rows()), new.count()
            if size == 0:
                return known
            front = one(new)
    finally:
        for x in open_tables:
            x.close()
    raise RuntimeError("the recursion didn't end")


def _with_fixed(step: ir.Plan, snap: Snapshot, n: int, open_tables: list[Buckets]) -> tuple[ir.Plan, Snapshot]:
    """The step with what its joins bring to the recursion variable written once, in n buckets by the join's keys."""
    over = dict(snap.overrides)

    def fix(p: ir.Plan, keys: tuple[int, ...]) -> ir.Plan:
        w = evaluate(p, snap)
        t = Buckets(snap.store.spark, "side", [f"c{k}" for k in dict.fromkeys(keys)], n)
        open_tables.append(t)
        t.add(w.df.select(*w.cols, *(() if w.unit else (W,))).repartition(n, *t.cols))
        df, name = t.table(), f"side {len(over)}\x00"
        over[name] = replace(w, df=df.withColumn(W, F.lit(1).cast("long")) if w.unit else df)
        return ir.Rel(name)

    def change(p: ir.Plan) -> ir.Plan | None:
        if not isinstance(p, ir.Join) or not p.left_keys:
            return None
        a, b = ir.recursion_uses(p.left), ir.recursion_uses(p.right)
        if a and not b:
            return replace(p, left=ir.substitute(p.left, change), right=fix(p.right, p.right_keys))
        return replace(p, left=fix(p.left, p.left_keys), right=ir.substitute(p.right, change)) if b and not a else None

    return ir.substitute(step, change), Snapshot(snap.store, snap.at, over)


class IncrementalFixpoint:
    """A fixpoint kept as a table and advanced by what changed: insertions grow it, deletions delete and rederive.

    Only linear steps are accepted.
    """

    def __init__(self, plan: ir.Iterate, snap: Snapshot):
        check_step(plan.step)
        if ir.recursion_uses(plan.step) > 1 or not _monotone(plan.step) or not _monotone(plan.init):
            raise ValueError("only linear, monotone steps are maintained")
        self.plan, self.at, self.store = plan, snap.at, snap.store
        self.state = fixpoint(plan, snap)
        self.last = "compute"

    def advance(self, to: int) -> Weighted:
        """The fixpoint at a later edition."""
        bases = sorted(ir.base_relations(self.plan))
        before, after = Snapshot(self.store, self.at), Snapshot(self.store, to)
        gone: dict[str, Weighted] = {}
        changed = False
        for name in bases:
            if not self.store.touched_since(name, self.at, to):
                continue
            changed = True
            diff = self.store.compare(name, self.at, to)
            lost = diff.where("w_a > 0 and w_b <= 0")
            types = before.relation(name).types
            lost = Weighted(lost.select(*[f"c{i}" for i in range(len(types))], F.lit(1).cast("long").alias(W)), types, True, True)
            if not lost.df.isEmpty():
                gone[name] = saved(lost, "lost")
        if not changed:
            self.last = "quiet"
        elif not gone:
            self.last = "grow"
            seed = evaluate(self.plan.init, after).union(evaluate(self.plan.step, after, self.state)).distinct()
            front = saved(_minus(seed, self.state), "front")
            self.state = saved(grow(self.plan, after, _both(self.state, front), front), "fix")
        else:
            self.last = "delete-rederive"
            # overdelete: whatever one derivation with a deleted row reaches, one base relation at a time
            seeds: Weighted | None = None
            for name, rows in gone.items():
                one = Snapshot(self.store, self.at, {name: rows})
                for part in (self.plan.init, self.plan.step):
                    # each occurrence of the relation stands for its deleted rows in turn, the others as they were
                    for variant in _one_at_a_time(part, name):
                        own = Snapshot(self.store, self.at, {**one.overrides, f"{name}\x00": rows, name: before.relation(name)})
                        d = evaluate(variant, own, self.state)
                        seeds = d if seeds is None else seeds.union(d)
            doomed = saved(_and(seeds.distinct(), self.state), "doomed")
            front = doomed
            while True:
                front = saved(_and(_minus(evaluate(self.plan.step, before, front).distinct(), doomed), self.state), "doomed")
                if front.df.isEmpty():
                    break
                doomed = saved(_both(doomed, front), "doomed")
            kept = saved(_minus(self.state, doomed), "kept")
            seed = evaluate(self.plan.init, after).union(evaluate(self.plan.step, after, kept)).distinct()
            front = saved(_minus(seed, kept), "front")
            self.state = saved(grow(self.plan, after, _both(kept, front), front), "fix")
        self.at = to
        return self.state


def _and(a: Weighted, b: Weighted) -> Weighted:
    return Weighted(a.df.join(b.df.select(*b.cols), a.cols, "left_semi").select(*a.cols, W), a.types, True, True)


def _one_at_a_time(p: ir.Plan, name: str) -> list[ir.Plan]:
    """Copies of p in which one occurrence of a base relation is its deleted rows (named with a NUL)."""
    n = sum(isinstance(x, (ir.Rel, ir.Range, ir.RangeOn)) and x.name == name for x in ir.walk(p))
    out = []
    for k in range(n):
        seen = iter(range(n))

        def change(x: ir.Plan, k=k, seen=seen) -> ir.Plan | None:
            if isinstance(x, (ir.Rel, ir.Range, ir.RangeOn)) and x.name == name and next(seen) == k:
                return replace(x, name=f"{name}\x00")
            return None

        out.append(ir.substitute(p, change))
    return out
