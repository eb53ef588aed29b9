"""What the operators share: the shared folder, written tables, batches of texts and word hashes."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and has one machine (tests), a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        import tempfile

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidelog-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


# --------------------------------------------------------------------------- batches


def chunks(texts: list, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about most_bytes characters; a longer text stands alone, whole."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most_bytes:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def slices(batch: pa.RecordBatch, text_col: str, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of batch with about most_bytes of text each, before any of it becomes Python objects."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with these columns replaced in place or appended."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for k, v in columns.items():
        if k in names:
            arrays[names.index(k)] = v
        else:
            names.append(k)
            arrays.append(v)
    return pa.RecordBatch.from_arrays(arrays, names=names)


# --------------------------------------------------------------------------- workers

_kept: dict[str, object] = {}


def kept(what: str, make: Callable[[], object]):
    """make(), kept in this worker between tasks of one operator."""
    if what not in _kept:
        _kept[what] = make()
    return _kept[what]


def _begin(keeps: str) -> None:
    for what in [k for k in _kept if k != keeps]:
        del _kept[what]


def trim() -> None:
    """Hand free memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """df.mapInArrow(run, schema) whose workers, which outlive tasks, hold no more than what keeps names between them."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(lean, schema)


# --------------------------------------------------------------------------- tables of counts

TABLE = "part int, task long, n long, blob binary"
PARTS, FAN = 16, 64  # pieces of a table; partial tables that one task adds


def partial_table(counts: np.ndarray, n: int) -> pa.RecordBatch:
    """This task's counts (int64, a multiple of PARTS) over n rows, as rows of TABLE."""
    task = TaskContext.get().partitionId()
    blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int64()), pa.array([n] * PARTS, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "task", "n", "blob"])


def summed_table(partial: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The sum of all tasks' partial tables and the number of rows; only tables of this fixed size move.

    Groups of FAN partial tables are added until one is left, so no task reads more than FAN, however many
    tasks there are.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // PARTS, np.int64)
        for b in pdf["blob"]:
            total += np.frombuffer(zlib.decompress(b), np.int64)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0] // FAN], "n": [pdf["n"].sum()], "blob": [zlib.compress(total.tobytes(), 1)]})

    tasks = partial.rdd.getNumPartitions()
    while True:
        partial = partial.groupBy("part", F.expr(f"task div {FAN}").alias("g")).applyInPandas(add, TABLE)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    got = {r["part"]: (r["n"], np.frombuffer(zlib.decompress(r["blob"]), np.int64)) for r in partial.toLocalIterator()}
    if not got:
        return np.zeros(size, np.int64), 0
    return np.concatenate([got[k][1] for k in range(PARTS)]), got[0][0]


# --------------------------------------------------------------------------- joins

HOT = 1000  # a key is hot if it holds a HOT-th of all rows: at most HOT keys are, at every size


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join, the same at every size: nothing that grows is broadcast because it's small yet."""
    return left.join(right.hint("merge"), on, how)


def split_join(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row per key and the number of its rows in times.

    Keys that hold a HOT-th of total rows are at most HOT; they alone are broadcast and their rows stay where
    they are.  The others are merged; rows of keys that keyed lacks go.
    """
    most = max(64, total // HOT)
    hot = F.broadcast(keyed.where(F.col(times) >= most))
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(merge_join(rest, keyed.where(F.col(times) < most), on))


# --------------------------------------------------------------------------- filters of ids

MOST_BITS = 27  # a filter has at most 2^27 bits, 16 MB, however many ids it holds


class IdFilter:
    """A Bloom filter (two bits an id) of bounded size over the ids of a table; when it's full it passes more ids."""

    def __init__(self, ids: DataFrame, id_col: str):
        spark, n = ids.sparkSession, ids.count()
        bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
        h = F.xxhash64(F.col(id_col).cast("long"))
        spot = F.explode(F.array(*[x.bitwiseAND(F.lit((1 << bits) - 1)) for x in (h, F.shiftrightunsigned(h, 32))])).alias("spot")
        words = ids.select(spot).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set")).toPandas()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
        self.bits, self.table = bits, spark.sparkContext.broadcast(table)

    def maybe(self, id_col: str):
        """A column: false for rows whose id surely isn't in the table.  Only hashes of ids go to Python."""
        bits, table = self.bits, self.table

        @F.pandas_udf("boolean")
        def probe(h: pd.Series) -> pd.Series:
            h, ok = h.to_numpy(np.int64), True
            for x in (h, (h.view(np.uint64) >> np.uint64(32)).view(np.int64)):
                spot = x & ((1 << bits) - 1)
                ok = ok & ((table.value[spot >> 6] >> (spot & 63)) & 1 == 1)
            return pd.Series(ok)

        return probe(F.xxhash64(F.col(id_col).cast("long")))


def rows_of(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is among ids; rows that surely aren't never leave their place."""
    return merge_join(docs.where(IdFilter(ids, id_col).maybe(id_col)), ids.select(id_col).distinct(), id_col, "left_semi")


def rows_but(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id isn't among ids (null ids stay); rows that surely stay never leave their place."""
    maybe = IdFilter(ids, id_col).maybe(id_col)
    return docs.where(~maybe).unionByName(merge_join(docs.where(maybe), ids.select(id_col).distinct(), id_col, "left_anti"))


# --------------------------------------------------------------------------- hashes of words

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _IS_WORD[_c] = _c >= 0x80 or chr(_c).isalnum()
_pow = {"n": 0, "p": np.ones(1, _U), "q": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = 1 << max(20, (n - 1).bit_length())
        p, q = np.full(m, _BASE, _U), np.full(m, _INV, _U)
        p[0] = q[0] = 1
        _pow.update(n=m, p=np.cumprod(p), q=np.cumprod(q))
    return _pow["p"][:n], _pow["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (constants of the public splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts, in order.

    A word is a run of ASCII letters and digits and of non-ASCII characters; case is folded first.
    Returns (hash per word, first word of each text with the total appended, the bytes, start of each word).
    """
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = len(buf)
    isw = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(isw.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is no word byte, so edges pair up
    p, q = _powers(n)
    cum = np.empty(n + 1, _U)
    cum[0] = 0
    np.cumsum(_BYTE[buf] * p, out=cum[1:])
    h = mix((cum[ends] - cum[starts]) * q[starts])
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lens, out=bounds[1:])
    first = np.searchsorted(starts, bounds)
    return h, first, buf, starts


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text; a text of 1 to k-1 words has one shingle of all its words.

    Returns (hashes, first shingle of each text with the total appended).
    """
    count = np.diff(first)
    m = len(words)
    if m == 0:
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    acc = words.copy()
    for j in range(1, k):
        nxt = np.zeros(m, _U)
        nxt[: max(0, m - j)] = words[j:]
        acc = acc * _U(_BASE) + nxt
    keep = np.zeros(m, bool)
    n_sh = np.maximum(count - k + 1, 0)
    long = n_sh > 0
    # positions first[i] .. first[i] + n_sh[i] - 1
    mark = np.zeros(m + 1, np.int32)
    np.add.at(mark, first[:-1][long], 1)
    np.add.at(mark, first[:-1][long] + n_sh[long], -1)
    keep = np.cumsum(mark[:-1]) > 0
    short = np.flatnonzero((count > 0) & (count < k))
    for i in short:  # few: texts of less than k words
        v = 0
        for w in words[first[i] : first[i + 1]].tolist():
            v = (v * _BASE + w) % (1 << 64)
        acc[first[i]] = _U((v + int(count[i])) % (1 << 64))
        keep[first[i]] = True
    total = np.where(long, n_sh, (count > 0).astype(np.int64))
    out = np.zeros(len(first), np.int64)
    np.cumsum(total, out=out[1:])
    return mix(acc[keep]), out
