"""Exact line deduplication over a sharded minimal perfect hash.

Distinct line hashes that at least two documents hold are dealt to shards.  Each shard gets a minimal
perfect hash (levels of bits with ranks) that indexes compact arrays: a 64-bit fingerprint, the number of
documents and the smallest document id.  Documents probe the arrays; lines are never joined.

Nothing grows but what is exchanged, and the number of passes never does: documents send their distinct line
hashes to the task of a shard, which probes its arrays and answers with the lines to drop, and the marks meet
the documents by id (documents without marks never leave their place).  A shard's lines are split by a salt
into groups of about ``probes_per_group``.  Lines that hold a thousandth of all (a thousand lines at most) are
broadcast as one more shard instead.

Defined results: null or empty text is one empty line; rows of a null id keep all lines and count nowhere;
repeated rows of one id are one document; an empty table gives an empty table; of other columns all stay,
but for ``n_lines`` and ``n_dropped``, which replace columns of that name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

BLANK = " \t\n\x0b\x0c\r"
_U = np.uint64


def line_key(line: str) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased (bytes.lower() folds ASCII only)."""
    return line.strip(BLANK).encode("utf-8", "surrogatepass").lower()


def key_hashes(text: str | None, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Indexes and 128-bit hashes of the lines whose key has min_chars code points at least."""
    at, out = [], []
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars:
            s = line.strip(BLANK)
            if len(s) >= min_chars:
                at.append(i)
                out.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower()))
    return at, out


def _emit(id_col: str, text_col: str, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in C.slices(batch, text_col, 4 << 20)):
            ids, hashes = [], []
            for i, t in zip(b.column(id_col).to_pylist(), b.column(text_col).to_pylist(), strict=True):
                if i is not None:
                    own = set(key_hashes(t, min_chars)[1])
                    hashes.extend(own)
                    ids.extend([i] * len(own))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], names=["h1", "h2", "doc"])

    return run


# --------------------------------------------------------------------------- minimal perfect hash


class PerfectHash:
    """Levels of bits: a key that is alone at its place of a level ends there; the rank of its bit is its slot."""

    GAMMA = 2.0

    def __init__(self, keys: np.ndarray):
        left, self.sizes, words = keys.astype(_U), [], []
        level = 0
        while len(left):
            size = max(64, (int(len(left) * self.GAMMA) + 63) // 64 * 64)
            at = self._at(left, level, size)
            n = np.bincount(at, minlength=size)
            bits = n == 1
            words.append(np.packbits(bits, bitorder="little").view(_U))
            self.sizes.append(size)
            left = left[~bits[at]]
            level += 1
            if level > 200:
                raise ValueError("keys aren't distinct")
        self.words = np.concatenate(words) if words else np.zeros(0, _U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = C.mix(keys + _U((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        return ((x >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that aren't in the set any slot, or -1."""
        keys = keys.astype(_U)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._at(keys[open_], level, size) + base
            word, bit = at >> 6, (at & 63).astype(_U)
            w = self.words[word]
            hit = (w >> bit) & _U(1) == 1
            below = np.bitwise_count(w[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[open_[hit]] = self.rank[word[hit]].astype(np.int64) + below
            open_ = open_[~hit]
            base += size
        return out


class Shard:
    """A perfect hash over the first half of line hashes, with fingerprint, count and first-document arrays."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, first: np.ndarray, n: np.ndarray):
        h1 = h1.astype(np.int64).view(_U)
        one, self.twins = np.unique(h1, return_index=True)[1], {}
        if len(one) < len(h1):  # equal first halves of different lines: kept beside, exactly
            rest = np.setdiff1d(np.arange(len(h1)), one)
            self.twins = {(int(h1[i]), int(h2[i])): int(first[i]) for i in rest}
        h1, h2, first, n = h1[one], h2[one], first[one], n[one]
        self.hash = PerfectHash(h1)
        at = self.hash.slots(h1)
        self.print = np.empty(len(h1), np.int64)
        self.first = np.empty(len(h1), np.int64)
        self.count = np.empty(len(h1), np.uint32)
        self.print[at], self.first[at], self.count[at] = h2, first, np.minimum(n, 0xFFFFFFFF)

    def owners(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line (held by two documents at least or not, smallest document)."""
        slot = self.hash.slots(h1.view(_U))
        ok = slot >= 0
        ok[ok] &= self.print[slot[ok]] == h2[ok]
        ok[ok] &= self.count[slot[ok]] >= 2
        first = np.zeros(len(h1), np.int64)
        first[ok] = self.first[slot[ok]]
        if self.twins:
            for i in np.flatnonzero(~ok):
                own = self.twins.get((int(h1.view(_U)[i]), int(h2[i])))
                if own is not None:
                    ok[i], first[i] = True, own
        return ok, first


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    s = Shard(*(pdf[c].to_numpy() for c in ("h1", "h2", "first", "n")))
    blob = pickle.dumps(s, protocol=5)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [blob]})


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 % shards).astype(np.int64)  # numpy's % is never negative here, as pmod


def _hashed(id_col: str, text_col: str, min_chars: int, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, hashes (two columns) and document of all lines of b that have a key; rows of a null id have none."""
    rows, where, hashes = [], [], []
    ids = b.column(id_col).to_pylist()
    for r, (i, t) in enumerate(zip(ids, b.column(text_col).to_pylist(), strict=True)):
        if i is not None:
            at, hs = key_hashes(t, min_chars)
            rows.extend([r] * len(at))
            where.extend(at)
            hashes.extend(hs)
    rows = np.array(rows, np.int64)
    doc = np.array([0 if i is None else i for i in ids], np.int64)[rows] if len(rows) else rows
    return rows, np.array(where, np.int64), np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), doc


def _probes(id_col: str, text_col: str, min_chars: int, shards: int, salts: int, hot):
    """What documents ask shards: lines of (hashes, document), packed by shard and salt; hot lines aren't asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in C.slices(batch, text_col, 4 << 20)):
            _, _, h, doc = _hashed(id_col, text_col, min_chars, b)
            lines = np.column_stack([h, doc])
            if hot.value is not None and len(lines):
                lines = lines[~hot.value.owners(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))[0]]
            lines = np.unique(lines, axis=0)
            salt = C.mix(np.ascontiguousarray(lines[:, 2]).view(_U)) % _U(salts)
            at = shard_of(lines[:, 0], shards) * salts + salt.astype(np.int64)
            order = np.argsort(at, kind="stable")
            group, start = np.unique(at[order], return_index=True)
            packed = [x.tobytes() for x in np.split(lines[order], start[1:])] if len(group) else []
            yield pa.RecordBatch.from_arrays([pa.array(group // salts, pa.int64()), pa.array(group % salts, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "salt", "lines"])

    return run


def _answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
    """The asked lines that another, smaller document owns, packed by document."""
    if shard.num_rows and asked.num_rows:
        table = pickle.loads(shard.column("blob")[0].as_py())
        lines = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 3) for x in asked.column("lines")])
        ok, first = table.owners(np.ascontiguousarray(lines[:, 0]), np.ascontiguousarray(lines[:, 1]))
        lines = lines[ok & (first != lines[:, 2])]
        lines = lines[np.argsort(lines[:, 2], kind="stable")]
        docs, start = np.unique(lines[:, 2], return_index=True)
        gone = [np.ascontiguousarray(x).tobytes() for x in np.split(lines[:, :2], start[1:])] if len(docs) else []
    else:
        docs, gone = np.zeros(0, np.int64), []
    return pa.table([pa.array(docs, pa.int64()), pa.array(gone, pa.binary())], names=["doc", "gone"])


def _drop(id_col: str, text_col: str, min_chars: int, hot, schema: pa.Schema):
    """Texts without the lines marked in ``__gone`` and without hot lines that another document owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in C.slices(batch, text_col, 4 << 20)):
            rows, where, h, doc = _hashed(id_col, text_col, min_chars, b)
            h1, h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
            away = np.zeros(len(rows), bool)
            if hot.value is not None and len(rows):
                ok, first = hot.value.owners(h1, h2)
                away = ok & (first != doc)
            dropped: dict[int, set] = {}
            cuts = np.searchsorted(rows, np.arange(b.num_rows + 1))
            for r, marks in enumerate(b.column("__gone").to_pylist()):
                lo, hi = cuts[r], cuts[r + 1]
                if marks and hi > lo:
                    own = {part[k : k + 16] for part in marks for k in range(0, len(part), 16)}
                    mine = h[lo:hi].tobytes()
                    away[lo:hi] |= np.fromiter((mine[k : k + 16] in own for k in range(0, len(mine), 16)), bool, hi - lo)
            for r, w in zip(rows[away].tolist(), where[away].tolist(), strict=True):
                dropped.setdefault(r, set()).add(w)
            kept, n_lines, n_dropped = [], [], []
            for r, t in enumerate(b.column(text_col).to_pylist()):
                d = dropped.get(r)
                n_lines.append((t or "").count("\n") + 1)
                n_dropped.append(len(d) if d else 0)
                kept.append("\n".join(x for j, x in enumerate(t.split("\n")) if j not in d) if d else (t or ""))
            out = C.put(b, **{text_col: pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})
            yield out.select(schema.names).cast(schema)

    return run


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, keys_per_shard: int = 1 << 16, probes_per_group: int = 1 << 18, hot_rows: int = 64
) -> DataFrame:
    """docs with the repeated lines gone from ``text_col``, and ``n_lines`` (before) and ``n_dropped``.

    A line repeats if its key (see line_key) has min_chars code points and at least two documents hold it;
    it stays in the smallest id only.
    """
    spark: SparkSession = docs.sparkSession
    docs = C.without(docs, "n_lines", "n_dropped", "__gone").withColumn(id_col, F.col(id_col).cast("long"))
    texts = docs.select(id_col, text_col)
    keys = C.map_arrow(texts, _emit(id_col, text_col, min_chars), "h1 long, h2 long, doc long")
    met = Observation()
    held = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("__last"), F.count(F.lit(1)).alias("n"))
    seen = C.written(held.observe(met, F.sum("n").alias("lines")).where("first < __last").drop("__last"), "lines")
    lines = met.get["lines"] or 0
    # at most C.HOT lines hold a HOT-th of all: they alone go to every worker, the others are asked for
    most = max(hot_rows, lines // C.HOT)
    often = seen.where(F.col("n") >= most).toPandas()
    hot = spark.sparkContext.broadcast(Shard(*(often[c].to_numpy() for c in ("h1", "h2", "first", "n"))) if len(often) else None)
    rest = seen.where(F.col("n") < most)
    shards = max(1, -(-rest.count() // keys_per_shard))
    salts = max(1, -(-lines // (shards * probes_per_group)))  # a group's lines are bounded; how many there are grows
    blobs = rest.withColumn("shard", F.expr(f"pmod(h1, {shards}L)")).groupBy("shard").applyInPandas(_build, "shard long, blob binary")
    blobs = C.written(blobs, "line-shards").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    asked = C.map_arrow(texts, _probes(id_col, text_col, min_chars, shards, salts, hot), "shard long, salt long, lines binary")
    gone = asked.groupBy("shard", "salt").cogroup(blobs.groupBy("shard", "salt")).applyInArrow(_answer, "doc long, gone binary")
    gone = C.written(gone, "line-marks")
    marks = gone.groupBy(F.col("doc").alias(id_col)).agg(F.collect_list("gone").alias("__gone"))
    maybe = C.IdFilter(gone.select(F.col("doc").alias(id_col)).distinct(), id_col).maybe(id_col)
    marked = C.merge_join(docs.where(maybe), marks, id_col, "left").select(*docs.columns, "__gone")
    docs = marked.unionByName(docs.where(~maybe).withColumn("__gone", F.lit(None).cast("array<binary>")))
    end = T.StructType([*docs.drop("__gone").schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return C.map_arrow(docs, _drop(id_col, text_col, min_chars, hot, to_arrow_schema(end)), end)


# --------------------------------------------------------------------------- query


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
rep AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (rep.first IS NOT NULL AND rep.first <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (rep.first IS NULL OR rep.first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN rep USING (k) GROUP BY doc_id
"""
