"""Instances of templates: facts of a block of entities copied with every entity moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import Ent, Schema, Ty


def shifted(log: DataFrame, schema: Schema, by: int) -> DataFrame:
    """log with every Ent column moved by an offset; a plain projection."""
    ents = {f"c{i}" for i, t in enumerate(schema.types) if t is Ty.ENT}
    return log.select(*[(F.col(c) + by).alias(c) if c in ents else F.col(c) for c in log.columns])


def instance(rows: list[tuple[tuple, int]], lo: int, hi: int, to: int) -> list[tuple[tuple, int]]:
    """The rows whose lead entity is in [lo, hi), with all entities moved to a block that begins at to."""
    move = lambda v: Ent(v + to - lo) if isinstance(v, Ent) else tuple(map(move, v)) if isinstance(v, tuple) else v
    return [(tuple(map(move, r)), w) for r, w in rows if r and isinstance(r[0], Ent) and lo <= r[0] < hi]
