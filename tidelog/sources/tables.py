"""The driver's tables as relations: registered where they lie, integers widened, everything at edition 1.

A null cell stays: it equals nothing, as in SQL, and its row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Schema, Ty
from .store import TraceStore, as_trace

I, X, S = Ty.INT, Ty.FLOAT, Ty.TEXT

# name -> (columns, whether the first one is the table's key)
TABLES: dict[str, tuple[list[tuple[str, Ty]], bool]] = {
    "region": ([("r_regionkey", I), ("r_name", S)], True),
    "nation": ([("n_nationkey", I), ("n_name", S), ("n_regionkey", I)], True),
    "customer": ([("c_custkey", I), ("c_name", S), ("c_nationkey", I), ("c_acctbal", X), ("c_mktsegment", S)], True),
    "supplier": ([("s_suppkey", I), ("s_name", S), ("s_nationkey", I), ("s_acctbal", X)], True),
    "part": ([("p_partkey", I), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I)], True),
    "orders": ([("o_orderkey", I), ("o_custkey", I), ("o_orderstatus", S), ("o_totalprice", X), ("o_orderpriority", S)], True),
    "lineitem": ([("l_orderkey", I), ("l_partkey", I), ("l_suppkey", I), ("l_linenumber", I), ("l_quantity", I), ("l_returnflag", S), ("l_linestatus", S)], False),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_table(store: TraceStore, sf_dir: str, name: str) -> None:
    columns, unique = TABLES[name]
    store.bulk(name, as_trace(table(store.spark, sf_dir, name), columns), Schema.of(*columns), unique=unique, key=(0,) if unique else None)


def world(spark: SparkSession, sf_dir: str, *names: str) -> TraceStore:
    """A store with the named tables."""
    store = TraceStore(spark)
    for n in names:
        add_table(store, sf_dir, n)
    return store


def events_log(spark: SparkSession, sf_dir: str, per_edition: int = 250) -> DataFrame:
    """The events as a signed trace of (user_id, bucket): per_edition events an edition, errors retract."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    e = e.withColumn("bucket", F.col("event_id") % 7)
    diff = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return as_trace(e, [("user_id", I), ("bucket", I)], F.floor(F.col("event_id") / per_edition) + 1, F.col("event_id") % per_edition, diff)


def events_world(spark: SparkSession, sf_dir: str, *names: str, per_edition: int = 250) -> TraceStore:
    """A store with the events trace as relation ``ev`` and the named tables."""
    store = world(spark, sf_dir, *names)
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    store.bulk("ev", events_log(spark, sf_dir, per_edition), Schema.of(("user_id", I), ("bucket", I)), 1, (last or 0) // per_edition + 1, positive=False)
    return store
