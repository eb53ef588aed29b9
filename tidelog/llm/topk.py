"""Exact top-k search by inner product with MaxScore.

A term is a pair (dimension, sign): a vector holds the term (d, +) with impact x if x > 0 and (d, -) with
impact -x if x < 0.  A query gives the term of the same sign a positive weight and that of the other sign a
negative one, so a term's score bound is weight x largest impact of the shard, or 0 for negative weights.
Per shard and query, terms are sorted by bound; with the k-th best score so far as threshold, those whose
bounds together stay below it are non-essential.  Postings of essential terms are traversed in blocks of
candidates, the others are probed, largest bound first, for candidates that can still compete.  Each
(shard, query block) yields its k best; merging those gives the exact answer, ties to the smaller id.

Vectors are dealt to shards of about ``shard_rows`` rows and queries to blocks of ``query_rows``; a cell of
the grid holds one of each, so no task's memory grows with the table and nothing is broadcast.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; vectors of
different lengths are scored over their common dimensions; repeated rows are rows of their own (same id: both
are listed, and neither answers its own id's query); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RESULT = "query_id long, vec_id long, score long"


class Postings:
    """The inverted lists of one shard, with a forward index to probe."""

    GROUP = 16  # dimensions probed between two looks at the threshold

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int):
        """ids ascending; largest: of the queries' components, by which products stay exact in doubles or not."""
        self.ids = ids
        most = int(np.abs(vectors).max()) if vectors.size else 0
        self.exact = np.float64 if most * largest * max(1, vectors.shape[1]) < 1 << 53 else np.int64
        self.v = np.ascontiguousarray(vectors.astype(self.exact))
        self.lists, self.most = {}, {}
        for d in range(vectors.shape[1]):
            x = vectors[:, d]
            for sign in (1, -1):
                at = np.flatnonzero(x * sign > 0)
                if len(at):
                    self.lists[d, sign] = at
                    self.most[d, sign] = int((x[at] * sign).max())

    def search(self, query_id: int, q: np.ndarray, k: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) for q, without rows whose id is query_id."""
        width = min(len(q), self.v.shape[1])
        terms = []  # (bound, dimension, sign)
        for d in np.flatnonzero(q[:width]).tolist():
            for sign in (1, -1):
                if (d, sign) in self.lists:
                    terms.append((max(0, int(q[d]) * sign * self.most[d, sign]), d, sign))
        terms.sort()
        bounds = np.cumsum([t[0] for t in terms]) if terms else np.zeros(0, np.int64)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = np.zeros(len(self.ids), bool)
        done[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, side="right")] = True
        floor = -np.inf

        weights = q[:width].astype(self.exact)
        bound_of = np.zeros(width, np.int64)
        for bound, d, _ in terms:
            bound_of[d] = max(bound_of[d], bound)  # a row is in one of the two lists of a dimension at most
        order = np.argsort(-bound_of, kind="stable")
        groups = [order[i : i + self.GROUP] for i in range(0, width, self.GROUP)]
        after = [int(bound_of[order[(i + 1) * self.GROUP :]].sum()) for i in range(len(groups))]

        def score(rows: np.ndarray) -> None:
            """Score candidates, terms of large bounds first, dropping those that can't compete any more."""
            nonlocal best_ids, best, floor
            own = self.v[rows]
            part = np.zeros(len(rows), self.exact)
            for dims, left in zip(groups, after, strict=True):
                part += own[:, dims] @ weights[dims]
                if floor > -np.inf:
                    alive = part + left >= floor
                    if not alive.all():
                        rows, part, own = rows[alive], part[alive], own[alive]
                        if not len(rows):
                            return
            if len(rows) > 4 * k:  # the k best and their ties are enough
                cut = np.partition(part, len(part) - k)[len(part) - k]
                rows, part = rows[part >= cut], part[part >= cut]
            ids = np.concatenate([best_ids, self.ids[rows]])
            scores = np.concatenate([best, part.astype(np.int64)])
            top = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[top], scores[top]
            if len(best) == k:
                floor = int(best[-1])

        first = len(terms) - 1
        while first >= 0:  # lists by falling bound, while the terms up to this one could reach the threshold
            if floor > -np.inf and bounds[first] < floor:
                return best_ids, best
            if not terms[first][0]:
                break
            rows = self.lists[terms[first][1], terms[first][2]]
            rows = rows[~done[rows]]
            done[rows] = True
            for lo in range(0, len(rows), block):
                if floor > -np.inf and bounds[first] < floor:
                    break
                score(rows[lo : lo + block])
            first -= 1
        if floor == -np.inf or floor <= 0:  # rows in no list of a positive weight score 0 at most
            rows = np.flatnonzero(~done)
            for lo in range(0, len(rows), block):
                score(rows[lo : lo + block])
        return best_ids, best


def _matrix(values: list) -> np.ndarray:
    """Vectors as a matrix, short ones filled with zeros, which add nothing."""
    width = max((len(v) for v in values), default=0)
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _cell(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        vectors = vectors.sort_values("id", kind="stable")
        largest = max((int(np.abs(q).max()) for q in queries["x"] if len(q)), default=0)
        shard = Postings(vectors["id"].to_numpy(np.int64), _matrix(vectors["x"].tolist()), largest)
        out = []
        for i, q in zip(queries["id"].tolist(), queries["x"].tolist(), strict=True):
            ids, scores = shard.search(i, np.asarray(q, np.int64), k)
            out.append(pd.DataFrame({"query_id": np.full(len(ids), i, np.int64), "vec_id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """Each query's k highest integer inner products among vectors, less the query's own id.

    vectors and queries: (id long, x array<long>).  Returns query_id, rank (from 1), vec_id, score.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    v = vectors.withColumn("shard", F.expr(f"pmod(xxhash64(id, x), {shards}L)")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 'block'), {blocks}L) as int)")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = v.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(_cell(k), RESULT)
    # merge of the shards: the k best of each query, kept small before and after the exchange
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, x) with x = floor(scale * component), without vectors that hold no number somewhere."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    ok = F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull()
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


# --------------------------------------------------------------------------- query


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
