"""Routing of changed rows to the watchers whose key spans hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(rows: DataFrame, key: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs of rows and spans with lo <= key < hi.

    An equi-join on cells of ``width`` keys (a span is repeated for each cell that it meets, a row stands in one),
    then the exact test; never all pairs.
    """
    cell = F.floor(F.col(key) / width)
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    spans = spans.where(F.col(lo) < F.col(hi)).withColumn("__cell", F.explode(cells))
    met = rows.withColumn("__cell", cell).join(spans, "__cell")
    return met.where((F.col(key) >= F.col(lo)) & (F.col(key) < F.col(hi))).drop("__cell")
