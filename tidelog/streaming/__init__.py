"""Structured Streaming: plans maintained as log files arrive.

A log folder holds Parquet files of log rows (c0.., __edition, __submit, __diff).  Each micro-batch brings the
change; ``maintain`` runs the plan's change over it in ``foreachBatch`` and hands signed rows to a sink together with
the batch id, which the sink stores with them: a batch that runs again after a failure changes nothing.  Plans that are monotone may also be run as plain append queries (``append``).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ir
from ..plans.check import classify
from ..plans.delta import Interval
from ..plans.find import Snapshot
from ..sources.store import META, TraceStore
from ..types import Schema


def log_stream(spark: SparkSession, path: str, schema: Schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of the log rows that are written to a folder."""
    fields = schema.spark()
    for m in META:
        fields = fields.add(m, "long")
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class DeltaTable:
    """Signed rows of a maintained view in a folder per batch; a batch writes its folder once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, change: DataFrame, batch: int) -> None:
        change.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")  # again gives the same folder

    def rows(self) -> DataFrame:
        """The view's rows: the sum of all changes."""
        df = self.spark.read.parquet(self.path).drop("batch")
        cols = [c for c in df.columns if c != "__diff"]
        return df.groupBy(*cols).agg(F.sum("__diff").alias("__diff")).where("__diff <> 0")


FOLD = 16  # batches whose rows are added up into one base


def _before(spark: SparkSession, kept: str, batch: int, schema: object) -> DataFrame:
    """What earlier batches brought: the last base and the rows after it."""
    last = batch // FOLD * FOLD
    paths = ([f"{kept}/base={last}"] if last else []) + [f"{kept}/batch={k}" for k in range(last, batch)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def maintain(log: DataFrame, rel: str, path: str, schema: Schema, plan: ir.Plan, sink: DeltaTable, checkpoint: str, names: list[str] | None = None, others: TraceStore | None = None) -> StreamingQuery:
    """Keep sink equal to plan while rows of rel arrive at path; other relations come from a store that stands still.

    A batch's own rows are the change against the rows of all batches before it, so an edition may span files and
    batches.  Rows are kept by batch number beside the sink (a batch that runs again writes the same folders), and
    every FOLD batches their sum is kept as a base.
    """
    spark, kept = log.sparkSession, f"{sink.path}.rows"

    def batch(rows: DataFrame, number: int) -> None:
        cells = [c for c in rows.columns if c not in META]
        now = rows.groupBy(*cells).agg(F.sum("__diff").alias("__diff")).where("__diff <> 0")
        now.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        now = spark.read.schema(now.schema).parquet(f"{kept}/batch={number}")
        if number and number % FOLD == 0:  # the sum of the base before and the rows since
            old, since = number - FOLD, [f"{kept}/batch={k}" for k in range(number - FOLD, number)]
            every = spark.read.schema(now.schema).parquet(*([f"{kept}/base={old}"] if old else []), *since)
            every.groupBy(*cells).agg(F.sum("__diff").alias("__diff")).where("__diff <> 0").write.mode("overwrite").parquet(f"{kept}/base={number}")
        store = TraceStore(spark) if others is None else others.fork_at(others.current)
        first = max(1, store.current)
        for df, e in ((_before(spark, kept, number, now.schema), first), (now, first + 1)):
            trace = df.select(*cells, F.lit(e).cast("long").alias("__edition"), F.lit(0).cast("long").alias("__submit"), "__diff")
            store.bulk(rel, trace, schema, e, e, positive=False)
        sink.write(Interval(store, first, first + 1).delta(plan, names), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(log: DataFrame, rel: str, schema: Schema, plan: ir.Plan, names: list[str] | None = None) -> DataFrame:
    """A monotone, stateless plan (filters, maps, projections, unions) over asserted rows as a streaming DataFrame."""
    if not classify(plan).monotone or any(isinstance(n, (ir.Distinct, ir.Join, ir.Iterate)) for n in ir.walk(plan)):
        raise ValueError("only filters, maps, projections and unions run as a plain append query")
    from ..plans.find import W, Weighted, evaluate

    cells = [f"c{i}" for i in range(len(schema))]
    rows = Weighted(log.select(*cells, F.col("__diff").alias(W)), schema.types)
    w = evaluate(plan, Snapshot(TraceStore(log.sparkSession), 0, {rel: rows}))
    return w.df.select(*[F.col(c).alias(n) for c, n in zip(w.cols, names or w.cols, strict=True)], F.col("__w").alias("__diff"))


class Pump:
    """foreachBatch deliveries into a driver-side receiver that remembers the last batch it took."""

    def __init__(self, take: Callable[[list[Any]], None]):
        self.take, self.last = take, -1

    def __call__(self, rows: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        self.take([tuple(r) for r in rows.orderBy(*rows.columns).toLocalIterator()])
        self.last = number
