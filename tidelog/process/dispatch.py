"""Behaviours found through prototypes."""

from __future__ import annotations

from ..plans import ir


def implements_plan(direct: str = "direct", prototype: str = "prototype") -> ir.Iterate:
    """(entity, behaviour): its own and what the entities above it have."""
    return ir.rel(direct).iterate(lambda x: ir.rel(prototype).join(x, [1], [0]).project(0, 3))
