"""Quality classifier by co-training.

Two views of a document: its text (which hashed words and word beginnings it holds, and shares of its words
that shout, repeat or carry symbols) and its metadata (language, source, length, lines, mix of characters).
All features are binary; numbers fall into fixed bins.  Each view has a logistic regression for each of two
labels, quality and toxicity.  They are fitted on a bounded sample of labelled documents (``train_rows``) and
then, over ``rounds``, each view labels the documents of an unlabelled pool (``pool_rows``) that it is surest
of for the other.  A quarter of the labelled sample is held out: on it each view is calibrated (Platt) and the
calibrated views are combined.  The result scores every document; kept are those of quality >= 0.5 and
toxicity < 0.5.

Only the fit is bounded; its samples are the first rows by hash of the id.  They and the fitted weights are all
that reaches the driver or is broadcast.

Defined results: null text, language and source count as empty; null ids are scored like others but never
trained on; a label that has one value only (or no rows) in the sample predicts that value (quality 1, toxicity
0) for all; repeated rows are scored alike; an empty table gives an empty table.  Of other columns all stay, but
for the four that are made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_U = np.uint64
WORDS = 1 << 18  # hashed words and beginnings; bins of shares follow
EDGES = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
BINS = len(EDGES) + 1
TEXT_DIMS = WORDS + 4 * BINS
LANGS, SOURCES, SIZES = 64, 512, 40
META_DIMS = LANGS + SOURCES + 3 * SIZES + 5 * BINS
DIMS = (TEXT_DIMS, META_DIMS)
LABELS = ("quality", "toxic")
LEAST = 3  # training documents that a feature must occur in

_UPPER, _LOWER, _DIGIT, _SYMBOL, _SPACE, _OTHER, _PUNCT = range(7)
_CLASS = np.full(256, _OTHER, np.int64)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = _UPPER if _s.isupper() else _LOWER if _s.islower() else _DIGIT if _s.isdigit() else _SPACE if _c <= 32 else _PUNCT if _s in ".,;:'\"()-?" else _SYMBOL
_FOLD = C._BYTE.copy()
_FOLD[65:91] = C._BYTE[97:123]


def views(texts: list, langs: list, sources: list) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(rows, features) of the text view and of the metadata view; a pair may repeat."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) + 1 for r in raw), np.int64, n)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    isw = C._IS_WORD[buf]
    edge = np.flatnonzero(np.diff(isw.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    p, q = C._powers(len(buf))
    cum = np.empty(len(buf) + 1, _U)
    cum[0] = 0
    np.cumsum(_FOLD[buf] * p, out=cum[1:])
    h = C.mix((cum[ends] - cum[starts]) * q[starts])
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(n), np.diff(first))
    rows, feats = [doc], [(h >> _U(46)).astype(np.int64)]
    for size in (4, 5):
        long = np.flatnonzero(ends - starts > size)
        s = starts[long]
        g = C.mix((cum[s + size] - cum[s]) * q[s] + _U(size))
        rows.append(doc[long])
        feats.append((g >> _U(46)).astype(np.int64))
    words = np.maximum(np.diff(first), 1)
    cls = _CLASS[buf]
    upper = np.concatenate([[0], np.cumsum(cls == _UPPER)])
    shout = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    symbol = cls[np.minimum(ends, len(buf) - 1)] == _SYMBOL
    bars = np.bincount(np.searchsorted(bounds, np.flatnonzero(buf == 124), side="right") - 1, minlength=n)
    shares = [np.bincount(doc[x], minlength=n) / words for x in (shout, same, symbol)] + [bars / words]
    every = np.arange(n)
    for k, x in enumerate(shares):
        rows.append(every)
        feats.append(WORDS + k * BINS + np.searchsorted(EDGES, x, side="right"))
    text = (np.concatenate(rows), np.concatenate(feats))

    which = np.repeat(every, lens)
    counts = np.bincount(which * 7 + cls, minlength=7 * n).reshape(n, 7)
    lines = np.add.reduceat(buf == 10, bounds[:-1]) if n else np.zeros(0, np.int64)
    size = lambda x: np.minimum(SIZES - 1, np.rint(2 * np.log2(1 + x))).astype(np.int64)
    hashed = lambda xs, m: np.fromiter((zlib.crc32((x or "").encode("utf-8", "surrogatepass")) % m for x in xs), np.int64, n)
    cols, at = [hashed(langs, LANGS), LANGS + hashed(sources, SOURCES)], LANGS + SOURCES
    for x in (lens, lines, lens / np.maximum(lines, 1)):
        cols.append(at + size(x))
        at += SIZES
    for k in (_UPPER, _DIGIT, _SYMBOL, _PUNCT, _OTHER):
        cols.append(at + np.searchsorted(EDGES, counts[:, k] / lens, side="right"))
        at += BINS
    return text, (np.tile(every, len(cols)), np.concatenate(cols))


# --------------------------------------------------------------------------- fitting


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """A logistic regression over binary features, fitted by full-batch Adam on the features that tell the labels apart."""

    def __init__(self, dims: int, most: int = 20_000, steps: int = 200, ridge: float = 1e-5):
        self.dims, self.most, self.steps, self.ridge = dims, most, steps, ridge
        self.w, self.b = np.zeros(dims), 0.0

    def fit(self, rows: np.ndarray, feats: np.ndarray, y: np.ndarray) -> Linear:
        n, pos = len(y), y.sum()
        on = np.bincount(feats, minlength=self.dims)
        hit = np.bincount(feats, weights=y[rows], minlength=self.dims)
        base = pos / n
        z = np.abs(hit - on * base) / np.sqrt(np.maximum(on * base * (1 - base), 1e-9))
        z[on < LEAST] = 0
        chosen = np.sort(np.argsort(-z, kind="stable")[: self.most])
        chosen = chosen[z[chosen] > 4.5]
        place = np.full(self.dims, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        spot = place[feats]
        keep = spot >= 0
        r, f = rows[keep].astype(np.int64), spot[keep].astype(np.int64)
        w, b = np.zeros(len(chosen)), np.log(max(pos, 0.5) / max(n - pos, 0.5))
        each = np.where(y > 0, 0.5 / max(pos, 1), 0.5 / max(n - pos, 1))  # both classes weigh the same
        m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
        for t in range(1, self.steps + 1):
            g = (_sigmoid(np.bincount(r, weights=w[f], minlength=n) + b) - y) * each
            gw, gb = np.bincount(f, weights=g[r], minlength=len(w)) + self.ridge * w, g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            c, d = 1 - 0.9**t, 1 - 0.99**t
            w -= 0.05 * (m / c) / (np.sqrt(v / d) + 1e-6)
            b -= 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-6)
        self.w[chosen], self.b = w, b
        return self

    def logits(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=self.w[feats], minlength=n) + self.b


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of x and 1, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ c)
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(c))
        c -= np.linalg.solve(h, a.T @ (p - y) + ridge * c)
    return c


class CoTrained:
    """Two linear views of one label, calibrated and combined."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fit(self, data: list, y: np.ndarray, known: np.ndarray, held: np.ndarray, rounds: int, batch: int, sure: float) -> CoTrained:
        """data: (rows, features) of both views, distinct pairs; y where known; held rows are for calibration."""
        n = len(y)
        labels = [np.where(known & ~held, y, np.nan) for _ in data]  # each view's training labels

        def fit_view(k: int) -> Linear:
            own = ~np.isnan(labels[k])
            number = np.cumsum(own) - 1
            r, f = data[k]
            use = own[r]
            return Linear(DIMS[k]).fit(number.astype(np.int32)[r[use]], f[use], labels[k][own])

        def calibrated(k: int, m: Linear) -> tuple[np.ndarray, np.ndarray]:
            z = m.logits(*data[k], n)
            return platt(z[held & known][:, None], y[held & known]), z

        self.views = [fit_view(k) for k in range(2)]
        for _ in range(rounds):
            told = []
            for k in range(2):
                c, z = calibrated(k, self.views[k])
                p = _sigmoid(z * c[0] + c[1])
                p[known] = 0.5
                pick = [np.argsort(-s, kind="stable")[:batch] for s in (p, 1 - p)]
                told.append([(i[s[i] >= sure], v) for i, s, v in ((pick[0], p, 1.0), (pick[1], 1 - p, 0.0))])
            for k in range(2):
                for i, v in told[1 - k]:
                    new = i[np.isnan(labels[k][i])]
                    labels[k][new] = v
            self.views = [fit_view(k) for k in range(2)]
        both = []
        self.scale = []
        for k in range(2):
            c, z = calibrated(k, self.views[k])
            self.scale.append(c)
            both.append(z * c[0] + c[1])
        at = held & known
        self.mixed = platt(np.column_stack(both)[at], y[at])
        return self

    def predict(self, data: tuple, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        z = [self.views[k].logits(*data[k], n) * self.scale[k][0] + self.scale[k][1] for k in range(2)]
        return _sigmoid(np.column_stack(z) @ self.mixed[:2] + self.mixed[2])

    def slim(self) -> CoTrained:
        """Weights as float32, for broadcast: some 2 MB, whatever the corpus."""
        for m in getattr(self, "views", []):
            m.w = m.w.astype(np.float32)
        return self


def _distinct(rows: np.ndarray, feats: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows * dims + feats)
    return key // dims, key % dims


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in C.slices(batch, "text"):
            n, cols = b.num_rows, []
            for (r, f), dims in zip(views(*[b.column(k).to_pylist() for k in ("text", "lang", "source")]), DIMS, strict=True):
                r, f = _distinct(r, f, dims)
                cuts = np.searchsorted(r, np.arange(n + 1))
                f = f.astype(np.int32)
                cols.append(pa.array([f[x:z].tobytes() for x, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("toxic"), *cols], names=["doc_id", "quality", "toxic", "text", "meta"])


def _fitted(got: pd.DataFrame, rounds: int, batch: int, sure: float) -> dict[str, CoTrained]:
    """The models of a sample: rows of _sample_features in any order."""
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
    out = {}
    data = []
    for name, dims in zip(("text", "meta"), DIMS, strict=True):
        parts = [np.frombuffer(x, np.int32) for x in got.pop(name)]
        f = np.concatenate([np.zeros(0, np.int32), *parts])
        r = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        often = (np.bincount(f, minlength=dims) >= LEAST)[f]  # others are never chosen
        data.append((r[often], f[often]))
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(got))
    for name in LABELS:
        y = got[name].to_numpy(np.float64, na_value=np.nan)
        known = np.isin(y, (0.0, 1.0))
        held = np.zeros(len(y), bool)
        held[order[known[order]][::4]] = True
        y = np.where(known, y, 0)
        if min((y[known & ~held] == v).sum() for v in (0, 1)) < 1 or min((y[known & held] == v).sum() for v in (0, 1)) < 1:
            out[name] = CoTrained(constant=float(y[known].mean() >= 0.5) if known.any() else float(name == "quality"))
        else:
            out[name] = CoTrained().fit(data, y, known, held, rounds, batch, sure).slim()
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, pool_rows: int = 3000, rounds: int = 3, batch: int = 150, sure: float = 0.98) -> dict[str, CoTrained]:
    """The co-trained models of both labels, from at most train_rows labelled and pool_rows other documents."""
    by_hash = F.xxhash64("doc_id")
    own = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), *[F.col(k).cast("int") for k in LABELS])
    # rows of the smallest hashes; a bound on the hash leaves some four times as many, so that no task sorts more
    few = lambda df, h, rows: df.where(h < F.lit(int(min(1.0, 4 * rows / max(1, df.count())) * (2.0**64 - 2048) - 2.0**63)))
    told = few(own, by_hash, train_rows).orderBy(by_hash, *LABELS).limit(train_rows).dropDuplicates(["doc_id"])
    all_ids, second = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null"), F.xxhash64("doc_id", F.lit(1))
    pool = few(all_ids, second, pool_rows).orderBy(second).limit(pool_rows).distinct()
    # both samples are bounded by their parameters, so they may be broadcast
    ids = told.join(pool.withColumn("pooled", F.lit(True)), "doc_id", "full").drop("pooled")
    base = docs.select(F.col("doc_id").cast("long"), *[F.col(k).cast("string") for k in ("text", "lang", "source")])
    rows = C.map_arrow(base.join(F.broadcast(ids), "doc_id"), _sample_features, "doc_id long, quality int, toxic int, text binary, meta binary")
    try:
        return _fitted(rows.toPandas(), rounds, batch, sure)
    finally:
        C.trim()


# --------------------------------------------------------------------------- scoring


def score(docs: DataFrame, models: dict[str, CoTrained], threshold: float = 0.5) -> DataFrame:
    """docs with ``p_quality``, ``p_toxic``, ``quality_score`` (both good at once) and ``keep``."""
    made = {"p_quality": T.DoubleType(), "p_toxic": T.DoubleType(), "quality_score": T.DoubleType(), "keep": T.BooleanType()}
    docs = C.without(docs, *made)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in made.items()]])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        used = [np.zeros(d, bool) for d in DIMS]
        for m in own.values():
            for k, v in enumerate(getattr(m, "views", [])):
                used[k] |= v.w != 0
        for batch in batches:
            for b in C.slices(batch, "text"):
                data, n = [], b.num_rows
                for k, (r, f) in enumerate(views(*[b.column(c).to_pylist() for c in ("text", "lang", "source")])):
                    on = used[k][f]
                    data.append(_distinct(r[on], f[on], DIMS[k]))
                good, bad = (own[k].predict(data, n) for k in LABELS)
                keep = (good >= threshold) & (bad < threshold)
                yield C.put(b, p_quality=pa.array(good), p_toxic=pa.array(bad), quality_score=pa.array(good * (1 - bad)), keep=pa.array(keep))

    return C.map_arrow(docs, run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rounded = [F.round(k, 6).alias(k) for k in ("p_quality", "p_toxic", "quality_score")]
    return score(docs.select("doc_id", "text", "lang", "source"), models).select("doc_id", *rounded, "keep")
