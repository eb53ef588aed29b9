"""Connected components by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label) for every node of edges (a long, b long); label is the smallest id of its component.

    No neighbourhood is gathered: each step takes minima by key (combined before the exchange) and joins them
    back.  Rounds end when the edges are a star around each smallest id; their number grows with the logarithm
    of the longest path.  Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    e = C.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself)
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        tied = large.join(low, F.col("u") == F.col("k"))
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = C.written(small, "edges")
        # settled when each node is tied once, to a node that is tied to none
        ends = e.select(F.col("u").alias("k"), F.lit(1).alias("tied"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("k").agg(F.sum("tied").alias("tied"), F.max("root").alias("root")).where("tied > 1 or (tied > 0 and root > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v")).distinct())
