"""Branches of a store: a graph of forks, and what descends from what."""

from __future__ import annotations

from ..sources.store import TraceStore


class Branches:
    """Named branches; each shares its parents' history up to where it left them."""

    def __init__(self, store: TraceStore, name: str = "main"):
        self.stores: dict[str, TraceStore] = {name: store}
        self.parents: dict[str, list[tuple[str, int]]] = {name: []}

    def branch(self, name: str, of: str, at: int | None = None) -> TraceStore:
        if name in self.stores:
            raise ValueError(f"branch {name} exists")
        at = self.stores[of].current if at is None else at
        self.stores[name] = self.stores[of].fork_at(at)
        self.parents[name] = [(of, at)]
        return self.stores[name]

    def open(self, name: str) -> TraceStore:
        return self.stores[name]

    def adopt(self, name: str, parent: str, at: int) -> None:
        """Record a further parent, as a merge has."""
        if name in self.lineage(parent):
            raise ValueError("a branch doesn't descend from itself")
        self.parents[name].append((parent, at))

    def lineage(self, name: str) -> list[str]:
        """The branch and its ancestors, nearest first."""
        out, level = [], [name]
        while level:
            out += [x for x in level if x not in out]
            level = [p for x in level for p, _ in self.parents[x] if p not in out]
        return out

    def descends_from(self, name: str, other: str) -> bool:
        return other in self.lineage(name)

    def common_ancestor(self, a: str, b: str) -> str | None:
        """The nearest branch that both descend from (or are)."""
        own = self.lineage(b)
        return next((x for x in self.lineage(a) if x in own), None)
