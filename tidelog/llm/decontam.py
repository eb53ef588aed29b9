"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts are compared in lower case with every run of other characters than letters and digits as one space.  A
document leaks an item if some region of it turns into the whole item by at most ``rate`` x length edits of
characters.  By the q-gram lemma such a region shares m + 1 - q - q e of the item's character q-grams (item
length m, budget e), and its hits lie within e + 1 neighbouring diagonals (place in the document less place in
the item).  Hits are counted per document and item in diagonal bands that overlap by e, bands that reach the
bound are retained, and a banded alignment of the whole item decides.

Items go out in blocks of at most ``block_chars`` characters, one pass over the documents per block, so what is
broadcast has a proven bound and every item is searched for.

Defined results: null and empty texts and items leak nothing, nor do items of less than ``min_chars`` normalised
characters (too short to tell apart); null item or document ids are kept as null; repeated documents are
searched alike, repeated items reported alike; documents are searched whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
Q = 10
_B = 0xD6E8FEB86659FD93
_ALNUM = np.ones(0x110000, bool)
_ALNUM[:0x10000] = np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)
_FILTER_BITS = 22
_pow = {"n": 0, "p": np.ones(1, _U), "q": np.ones(1, _U)}

LEAKS = "doc_id long, item_id long, distance int, item_chars int, start long, end long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = 1 << max(20, (n - 1).bit_length())
        p, q = np.full(m, _B, _U), np.full(m, pow(_B, -1, 1 << 64), _U)
        p[0] = q[0] = 1
        _pow.update(n=m, p=np.cumprod(p), q=np.cumprod(q))
    return _pow["p"][:n], _pow["q"][:n]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in normal form, a zero after each, and where each begins, with the end appended."""
    joined = "\x00".join(t.lower().replace("\x00", " ") for t in texts) + "\x00"
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word, end = _ALNUM[a], a == 0
    before = np.empty(len(a), bool)
    before[0] = False
    before[1:] = word[:-1]
    keep = word | end | before  # a space after each word, but before the end of a text too
    out = np.where(word | end, a, 32)[keep].astype(np.uint32)
    ends = np.flatnonzero(out == 0)
    return out, np.concatenate([[0], ends + 1])


def gram_hashes(a: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q code points from each place on."""
    n = len(a)
    if n < q:
        return np.zeros(0, _U)
    p, inv = _powers(n)
    cum = np.empty(n + 1, _U)
    cum[0] = 0
    np.cumsum((a.astype(_U) + _U(7)) * p, out=cum[1:])
    h = (cum[q:] - cum[:-q]) * inv[: n - q + 1]
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int, q: int = Q):
        self.q, self.ids, self.items = q, [], []
        for i, t in items:
            a = normalised([t or ""])[0][:-1]
            if len(a) and a[-1] == 32:
                a = a[:-1]
            if len(a) >= max(min_chars, q):
                self.ids.append(i)
                self.items.append(a)
        m = np.array([len(a) for a in self.items], np.int64)
        self.ahead = 1 << max(20, int(m.max(initial=0)).bit_length())  # no diagonal is below less than that
        # the budget: rate x length, but no more than leaves the lemma a bound of one shared q-gram
        self.budget = np.maximum(0, np.minimum((m * rate).astype(np.int64), (m - q) // q)) if len(m) else m
        self.bound = m + 1 - q - q * self.budget
        self.shift = np.array([max(4, int(e).bit_length()) for e in self.budget], np.int64)  # bands of 2^shift > e diagonals
        grams = [gram_hashes(a, q) for a in self.items]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        h = np.concatenate(grams) if grams else np.zeros(0, _U)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.keys >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands that reach the bound."""
        none = (np.zeros(0, np.int64),) * 3
        h = gram_hashes(a, self.q)
        at = np.flatnonzero(self.seen.take((h >> _U(64 - _FILTER_BITS)).view(np.int64)))
        if not len(at) or not len(self.keys):
            return none
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        if not n.sum():
            return none
        spot = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos, item = np.repeat(at, n), self.item[spot]
        diagonal = pos - self.place[spot] + self.ahead
        text = np.searchsorted(starts, pos, side="right") - 1
        shift = self.shift[item]
        band = diagonal >> shift
        edge = (diagonal & ((np.int64(1) << shift) - 1)) < self.budget[item]  # belongs to the band before, too
        key = (text * len(self.items) + item) << 32
        every = np.concatenate([key | band, key[edge] | (band[edge] - 1)])
        keys, count = np.unique(every, return_counts=True)
        pair, band = keys >> 32, keys & 0xFFFFFFFF
        text, item = pair // len(self.items), pair % len(self.items)
        good = count >= self.bound[item]
        text, item, band = text[good], item[good], band[good]
        return text, item, (band << self.shift[item]) - self.ahead

    def align(self, item: int, windows: list[np.ndarray], band: int) -> list[tuple[int, int]]:
        """(distance, end in the window) of the whole item in each window, free at both ends of the window.

        Row i of the table holds prefixes of i characters against window places i .. i + band, so a path may
        use band + 1 diagonals; all windows advance together.
        """
        x = self.items[item]
        m, n, width = len(x), len(windows), band + 1
        w = np.zeros((n, m + width), np.uint32)
        for r, v in enumerate(windows):
            w[r, : min(len(v), m + width)] = v[: m + width]
        step = np.arange(width)
        row = np.zeros((n, width), np.int64)  # no characters: every start is free
        far = np.full((n, 1), m + width)
        for i in range(m):
            same = row + (w[:, i : i + width] != x[i])
            up = np.concatenate([row[:, 1:], far], 1) + 1  # an item character without a counterpart
            best = np.minimum(same, up)
            row = np.minimum.accumulate(best - step, 1) + step  # window characters without a counterpart
        end = row.argmin(1)
        return [(int(row[r, e]), m + int(e)) for r, e in enumerate(end)]

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end), the best region of each text and item, places in the normal form."""
        a, starts = normalised(texts)
        text, item, diagonal = self.candidates(a, starts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in np.unique(item).tolist():
            own = np.flatnonzero(item == k)
            m, e = len(self.items[k]), int(self.budget[k])
            reach = (1 << int(self.shift[k])) + e  # diagonals of one band
            lo = np.maximum(diagonal[own] - e, starts[text[own]])
            # in most leaks some diagonal holds the item as it is
            rest = []
            for j, (t, s) in enumerate(zip(text[own].tolist(), lo.tolist(), strict=True)):
                stop = int(starts[t + 1]) - 1
                window = a[s : min(stop, s + m + reach + 2 * e)]
                near = np.flatnonzero(window[: max(0, len(window) - m + 1)] == self.items[k][0])
                hit = next((int(z) for z in near if np.array_equal(window[z : z + m], self.items[k])), None)
                if hit is not None:
                    best[t, k] = (0, s + hit - int(starts[t]), s + hit + m - int(starts[t]))
                elif best.get((t, k), (1,))[0]:
                    rest.append((t, s, window))
            for j in range(0, len(rest), 256):
                part = rest[j : j + 256]
                for (t, s, window), (d, end) in zip(part, self.align(k, [x[2] for x in part], reach + 2 * e), strict=True):
                    end = min(end, len(window))
                    if d <= e and d < best.get((t, k), (d + 1,))[0]:
                        best[t, k] = (d, max(0, s + end - m - int(starts[t])), s + end - int(starts[t]))
        return [(t, k, *v) for (t, k), v in best.items()]


def find_leaks(
    docs: DataFrame, items: DataFrame, rate: float = 0.08, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4 << 20
) -> DataFrame:
    """One row (LEAKS) per document and benchmark item that it leaks."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate, min_chars)
            for batch in batches:
                out = []
                for b in C.slices(batch, "text") if index.items else ():
                    ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
                    out += [(ids[t], index.ids[k], d, len(index.items[k]), s, e) for t, k, d, s, e in index.leaks(texts)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in LEAKS.split(", ")])

        return C.map_arrow(base, run, LEAKS)

    found = [search(b) for b in _blocks(items, item_col, item_text, block_chars)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _blocks(items: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[list]:
    """The items in blocks of at most block_chars characters (a longer item alone), one block at least."""
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.08, min_chars: int = 40, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4 << 20) -> DataFrame:
    """docs less those that leak an item, found as find_leaks finds them; a pass for each block, no exchange."""
    for number, block in enumerate(_blocks(items, item_col, item_text, block_chars)):
        if number:  # so that a worker holds the index of one block
            docs = C.written(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate, min_chars)
            for batch in batches:
                for b in C.slices(batch, text_col):
                    texts = [t or "" for t in b.column(text_col).to_pylist()]
                    keep = np.ones(len(texts), bool)
                    keep[[x[0] for x in (index.leaks(texts) if index.items else ())]] = False
                    yield b.filter(pa.array(keep))

        docs = C.map_arrow(docs, run, docs.schema)
    return docs


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
