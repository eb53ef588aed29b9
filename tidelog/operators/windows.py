"""Windows over the edition axis: half-open intervals (lo, hi]."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("__edition", "__submit", "__diff")


@dataclass(frozen=True, order=True)
class Editions:
    """The editions after lo up to hi."""

    lo: int
    hi: int

    def __post_init__(self) -> None:
        if self.lo > self.hi:
            raise ValueError("a window runs backwards")

    def contains(self, e: int) -> bool:
        return self.lo < e <= self.hi

    @property
    def span(self) -> int:
        return self.hi - self.lo

    def is_empty(self) -> bool:
        return self.lo == self.hi

    # -------------------------------------------------- as lists, for the driver

    def tumbling(self, size: int) -> list[Editions]:
        return self.sliding(size, size)

    def sliding(self, size: int, step: int) -> list[Editions]:
        _check(size, step)
        return [Editions(a, min(a + size, self.hi)) for a in range(self.lo, self.hi, step)]

    @staticmethod
    def sessions(active: Iterable[int], timeout: int) -> list[Editions]:
        active = list(active)
        if timeout <= 0 or any(b <= a for a, b in zip([0, *active], active)):
            raise ValueError("sessions need a timeout above 0 and ascending editions above 0")
        out: list[list[int]] = []
        for e in active:
            if out and e - out[-1][-1] <= timeout:
                out[-1].append(e)
            else:
                out.append([e])
        return [Editions(s[0] - 1, s[-1]) for s in out]


def _check(size: int, step: int) -> None:
    if not 0 < step <= size:
        raise ValueError("windows need 0 < step <= size")


# --------------------------------------------------------------------------- over log rows


def tumbling(log: DataFrame, size: int, lo: int, hi: int) -> DataFrame:
    """log with w_from and w_to, windows of size editions, the last cut at hi; no exchange."""
    _check(size, size)
    start = F.lit(lo) + F.floor((F.col("__edition") - lo - 1) / size) * size
    return _inside(log, lo, hi).withColumn("w_from", start.cast("long")).withColumn("w_to", F.least(F.col("w_from") + size, F.lit(hi)).cast("long"))


def sliding(log: DataFrame, size: int, step: int, lo: int, hi: int) -> DataFrame:
    """Each row once for every window it is in; anchors lo + k step below hi."""
    _check(size, step)
    e = F.col("__edition")
    first = F.greatest(F.lit(0), F.floor((e - lo - size + step - 1) / step))
    last = F.least(F.floor((e - lo - 1) / step), F.lit((hi - lo - 1) // step))
    out = _inside(log, lo, hi).withColumn("__k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return out.withColumn("w_from", (F.lit(lo) + F.col("__k") * step).cast("long")).withColumn("w_to", F.least(F.col("w_from") + size, F.lit(hi)).cast("long")).drop("__k")


def _inside(log: DataFrame, lo: int, hi: int) -> DataFrame:
    if lo > hi:
        raise ValueError("a window runs backwards")
    return log.where((F.col("__edition") > lo) & (F.col("__edition") <= hi))


def sessions(log: DataFrame, timeout: int, by: Iterable[str] = ()) -> DataFrame:
    """(by.., w_from, w_to): runs of active editions no two of which are more than timeout apart.

    Only distinct editions (per key) are sorted, of which there are as many as commits, not rows.
    """
    if timeout <= 0:
        raise ValueError("a timeout is above 0")
    by = list(by)
    active = log.select(*by, "__edition").where("__edition > 0").distinct()
    w = Window.partitionBy(*by).orderBy("__edition") if by else Window.orderBy("__edition")
    gap = F.col("__edition") - F.lag("__edition").over(w)
    runs = active.withColumn("__new", F.when(gap.isNull() | (gap > timeout), 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*by, "__run").agg((F.min("__edition") - 1).alias("w_from"), F.max("__edition").alias("w_to")).drop("__run")


def last_n(log: DataFrame, n: int) -> DataFrame:
    """The last n updates in commit order; retractions take a place too."""
    return log.orderBy(F.desc("__edition"), F.desc("__submit")).limit(n)


class CountWindow:
    """The last n updates, kept while updates arrive; each push tells what came in and what fell out."""

    def __init__(self, n: int):
        if n <= 0:
            raise ValueError("a count window holds 1 update at least")
        self.n, self.held = n, []

    def push(self, updates: list) -> tuple[list, list]:
        every = self.held + list(updates)
        self.held = every[-self.n :]
        return list(updates), every[: len(every) - len(self.held)]


def consolidate_events(log: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Weights of equal rows added over the given log rows alone, zeros gone."""
    cols = [*by, *[c for c in log.columns if c not in META and c not in by and c not in ("w_from", "w_to")]]
    return log.groupBy(*cols).agg(F.sum("__diff").alias("__diff")).where("__diff <> 0")


def state_window(log: DataFrame, lo: int, hi: int) -> DataFrame:
    """Net contents of (lo, hi]: rows whose weight changed, at their weight at hi, zeros gone; one pass over the log."""
    cols = [c for c in log.columns if c not in META]
    inside = F.sum(F.when(F.col("__edition") > lo, F.col("__diff")).otherwise(F.lit(0)))
    net = log.where(F.col("__edition") <= hi).groupBy(*cols).agg(inside.alias("__change"), F.sum("__diff").alias("__diff"))
    return net.where("__change <> 0 and __diff <> 0").drop("__change")


def values(weighted: DataFrame) -> DataFrame:
    """One row for each unit of a positive weight."""
    cols = [c for c in weighted.columns if c != "__diff"]
    return weighted.where("__diff > 0").select(*cols, F.explode(F.array_repeat(F.lit(1), F.col("__diff").cast("int"))).alias("__u")).drop("__u")


def signed(log: DataFrame) -> Column:
    """An update as the pattern algebra sees it: (sign, row, edition)."""
    cols = [c for c in log.columns if c not in META]
    return F.struct(F.signum("__diff").cast("int").alias("sign"), F.struct(*cols).alias("row"), F.col("__edition").alias("edition"))
