"""Near-duplicate detection by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Inverse frequencies of word shingles (five words) count independent documents: a document of a family of n near
   copies counts 1 / n, so that copies don't make their own shingles look common (they would then fall apart).  A
   document's family is estimated by the third largest count of its ``MINIMA`` min-hashes over all documents.  Both counts
   are hashed tables of fixed size, summed by a tree of groups; a bucket's mean load of unrelated entries is taken
   off, so they tell shares of the corpus from 1 / BUCKETS up, at every size; rarer shingles weigh most, all alike.
2. One pass makes, per document, a hash of its text and ICWS samples of its TF-IDF vector (tf as
   1 + ln tf): for a shingle of weight w and draws r, c ~ Gamma(2,1), beta ~ U(0,1) it takes t = floor(ln w / r + beta) and
   ln a = ln c - r (t - beta + 1); the smallest a of a document is its sample.  Two documents agree on a sample
   with the probability of their weighted Jaccard similarity.  Samples are kept as one byte each.
3. Exact copies are represented by their smallest id.  ``bands`` bands of ``rows`` samples deal representatives
   to buckets.  A bucket's hub is the member with most collisions; each member meets the hub that it agrees with most, so
   a group of near copies costs a pair per member.  Then members of one bucket that aren't connected yet are compared
   all with each other by their samples, in cells of about ``CELL`` by ``CELL`` members dealt by hashes (two members of a
   bucket's largest component need no look).  A cell gives a forest of those that agree enough, never all pairs; its
   components over all cells are families, whose unconnected members meet again in cells, with whole texts, and a cell
   gives a forest of verified links.  So no link of a bucket is left out, what moves grows with members times cells, and
   only the comparisons inside cells grow with the square of a family.
4. Pairs that agree on enough samples are verified by exact weighted Jaccard similarity on their whole texts,
   and connected components of verified pairs are the classes.  Only texts of such pairs move (bounded filters of
   ids keep the others in place), each once to a block of pairs.

Words are case-folded runs of ASCII letters and digits and non-ASCII characters.  Defined results: equal texts are
copies, null counting as empty, and texts without a word have no other near duplicates; rows of a null id get a null class; repeated rows of an id share its class; a text of one to four words
has one shingle of all its words; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

_U = np.uint64
BITS = 20
BUCKETS = 1 << BITS
MINIMA = 9
UNIT = 1 << 16  # counts of independent documents are kept in 65536ths
CELL = 1024
KEY = _U(44)  # bits of a shingle's key within a document


def _keys(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle key, times) of the distinct shingles of texts, sorted."""
    h, first, _, _ = C.word_hashes(texts)
    s, at = C.shingle_hashes(h, first, shingle)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    both, times = np.unique((doc << KEY) | (s >> (_U(64) - KEY)), return_counts=True)
    return (both >> KEY).astype(np.int64), both & ((_U(1) << KEY) - _U(1)), times


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> (KEY - _U(BITS))).astype(np.int64)


# --------------------------------------------------------------------------- document frequencies


def _minima(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets of MINIMA min-hashes for each group of keys that begins at at."""
    odd = C.mix(np.arange(101, 101 + MINIMA, dtype=np.uint64)) | _U(1)
    x = C.mix(keys)
    low = np.stack([np.minimum.reduceat(x * m, at) for m in odd], 1)
    return (C.mix(low + odd) >> _U(64 - BITS)).astype(np.int64)


def _less_load(counts: np.ndarray) -> np.ndarray:
    """What a bucket holds beyond the mean load, within the noise of that load at least one."""
    load = counts.mean()
    return np.where(counts - load > 4 * np.sqrt(load), counts - load, 1.0) if load > 1 else np.maximum(counts, 1.0)


def _count(text_col: str, shingle: int, family=None):
    """Partial counts of min-hashes or, with the sizes of families, of shingles over independent documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for b in C.slices(batch, text_col):
                doc, keys, _ = _keys([t or "" for t in b.column(text_col).to_pylist()], shingle)
                has, at, nth = np.unique(doc, return_index=True, return_inverse=True)
                if not len(has):
                    continue
                spots = _minima(keys, at)
                if family is None:
                    spot, times = np.unique(spots, return_counts=True)
                    counts[spot] += times
                    n += len(has)
                    continue
                weight = np.maximum(1, np.rint(UNIT / np.sort(family.value[spots], axis=1)[:, -3])).astype(np.int64)
                n += int(weight.sum())
                bucket = bucket_of(keys)  # sorted within a document, as its keys are
                one = np.append(True, (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1]))
                np.add.at(counts, bucket[one], weight[nth[one]])
        yield C.partial_table(counts, n)

    return run


def inverse_frequencies(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)) of each bucket, float32, N and df in independent documents; a table of fixed size."""
    spark, texts = docs.sparkSession, docs.select(text_col)
    minima, _ = C.summed_table(C.map_arrow(texts, _count(text_col, shingle), C.TABLE), BUCKETS)
    family = spark.sparkContext.broadcast(_less_load(minima.astype(np.float64)).astype(np.float32))  # 4 MB at every size
    df, n = C.summed_table(C.map_arrow(texts, _count(text_col, shingle, family), C.TABLE), BUCKETS)
    family.unpersist()
    return (1 + np.log((1 + n / UNIT) / (1 + _less_load(df / UNIT)))).astype(np.float32)


# --------------------------------------------------------------------------- sampling


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    lo, hi = np.zeros(len(p)), np.full(len(p), 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        up = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """ICWS with draws looked up by 16-bit fields of a multiplicative hash of the shingle's key."""

    def __init__(self, samples: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)
        q = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.r = _gamma2(q).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(_gamma2(q)).astype(np.float32)
        self.beta = q.astype(np.float32)

    def sample(self, keys: np.ndarray, ln_w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row of samples (as uint32) for each group of elements that begins at at."""
        x = C.mix(keys)
        out = np.empty((len(at), len(self.odd)), np.float32)
        for k, m in enumerate(self.odd):
            f = (x * m).view(np.uint16).reshape(-1, 4)  # the highest three fields are the best mixed
            i = np.ascontiguousarray(f[:, 3]).astype(np.intp)
            r, beta = self.r.take(i), self.beta.take(np.ascontiguousarray(f[:, 1]).astype(np.intp))
            t = ln_w * self.inv.take(i)
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += np.float32(1)
            t *= r
            a = self.ln_c.take(np.ascontiguousarray(f[:, 2]).astype(np.intp))
            a -= t
            out[:, k] = np.minimum.reduceat(a, at)
        return out.view(np.uint32)


def _sign(id_col: str, text_col: str, shingle: int, idf, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sampler = idf.value, Sampler(bands * rows)
        salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for b in C.slices(batch, text_col):
                ids, own = b.column(id_col), [t or "" for t in b.column(text_col).to_pylist()]
                content = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in own), np.int64).reshape(-1, 2)
                doc, keys, times = _keys(own, shingle)
                w = weight[bucket_of(keys)] * (1 + np.log(times.astype(np.float32)))
                has, at = np.unique(doc, return_index=True)
                sigs: list = [None] * len(own)
                band: list = [None] * len(own)
                if len(has):
                    s = sampler.sample(keys, np.log(w), at)
                    key = np.tile(salt, (len(has), 1))
                    for r in range(rows):
                        key = C.mix(key + s[:, r * bands : (r + 1) * bands].astype(_U))
                    key = key.view(np.int64)
                    s = (C.mix(s.astype(_U)) >> _U(56)).astype(np.uint8)
                    for j, d in enumerate(has.tolist()):
                        sigs[d], band[d] = s[j].tobytes(), key[j]
                total = np.bincount(doc, weights=w, minlength=len(own))
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(total), pa.array(sigs, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                    names=["id", "c1", "c2", "total", "sig", "band"],
                )

    return run


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _agree(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = (_bytes(b.column("sig_a"), b.num_rows) == _bytes(b.column("sig_b"), b.num_rows)).sum(1)
                ok = pa.array(np.flatnonzero(n >= least))
                yield pa.RecordBatch.from_arrays([b.column("a").take(ok), b.column("b").take(ok), pa.array(n.astype(np.int32)).take(ok)], names=["a", "b", "agree"])

    return run


def _whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], most_bytes: int, heavy: str) -> Iterator[pa.Table]:
    """Rows that come sorted by some columns, in tables of whole groups of about most_bytes in the column heavy."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.column(heavy).nbytes
        if size < most_bytes:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        last = np.ones(rows.num_rows, bool)
        for k in by:
            v = rows.column(k).to_numpy()
            last &= v == v[-1]
        cut = rows.num_rows - int(last.sum())
        if cut:
            yield rows.slice(0, cut)
            rows = rows.slice(cut)
        held, size = [rows], rows.column(heavy).nbytes if cut else size
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _pairs_in(cells: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one cell; cells gives where each begins and the end, sides where its second slot begins."""
    size = np.diff(cells)
    for m in np.unique(size[size <= 24]).tolist():
        i, j = np.triu_indices(m, 1)
        at = cells[:-1][size == m][:, None]
        for part in np.array_split(at, max(1, len(at) * len(i) >> 18)):
            yield (part + i).ravel(), (part + j).ravel()
    for lo, mid, hi in zip(cells[:-1][size > 24].tolist(), sides[size > 24].tolist(), cells[1:][size > 24].tolist(), strict=True):
        if lo < mid:  # all of one slot with all of the other
            step = max(1, (1 << 18) // max(1, hi - mid))
            for a in range(lo, mid, step):
                i = np.arange(a, min(a + step, mid))
                yield np.repeat(i, hi - mid), np.tile(np.arange(mid, hi), len(i))
            continue
        step = max(1, (1 << 18) // (hi - lo))
        for a in range(lo, hi - 1, step):
            i = np.arange(a, min(a + step, hi - 1))
            yield np.repeat(i, hi - 1 - i), np.concatenate([np.arange(k + 1, hi) for k in i])


def _agreeing(rows: pa.Table, by: str, least: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different labels within cells (rows come sorted by cell and slot) that agree on least samples."""
    group, x, y, slot, label, total = (rows.column(k).to_numpy() for k in (by, "x", "y", "slot", "label", "total"))
    sig = _bytes(rows.column("sig"), len(x))
    new = np.ones(len(x), bool)
    new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    cells = np.append(np.flatnonzero(new), len(x))
    second = np.cumsum(np.append(0, (slot == x) & (x < y)))  # rows of a cell's first slot come first
    for i, j in _pairs_in(cells, cells[:-1] + second[cells[1:]] - second[cells[:-1]]):
        on = (label[i] != label[j]) & ((slot[i] != slot[j]) | (x[i] == y[i])) & (np.minimum(total[i], total[j]) >= ratio * np.maximum(total[i], total[j]))
        i, j = i[on], j[on]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            on = (sig[p] == sig[q]).sum(1) >= least
            if on.any():
                yield p[on], q[on]


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, with edges i, j added."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for k in (i, j, root[i], root[j]):
            np.minimum.at(new, k, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


EDGES = "a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _kin(least: int, ratio: float):
    """An edge for each member of a cell that agrees with a member of another label: a forest, not all such pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, ("key", "x", "y"), 1 << 17, "sig"):  # some two cells
            root = np.arange(rows.num_rows)
            for i, j in _agreeing(rows, "key", least, ratio):
                root = _merge(root, i, j)
            ids, at = rows.column("id").to_numpy(), np.flatnonzero(root != np.arange(len(root)))
            yield _edges(ids[at], ids[root[at]])

    return run


class Vectors:
    """TF-IDF vectors of some texts."""

    def __init__(self, texts: list, shingle: int, weight: np.ndarray):
        texts, made = [t or "" for t in texts], [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
        for lo, hi in C.chunks(texts):  # hashing takes some 60 bytes a character
            d, k, n = _keys(texts[lo:hi], shingle)
            made.append((d + lo, k, n))
        doc, self.keys, times = (np.concatenate([m[i] for m in made]) for i in range(3))
        self.w = weight[bucket_of(self.keys)].astype(np.float64) * (1 + np.log(times))
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.total = np.bincount(doc, weights=self.w, minlength=len(texts))
        self.size = np.diff(self.first)

    def linked(self, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the weighted Jaccard similarity of each pair reaches the threshold."""
        ok = np.zeros(len(left), bool)
        step = np.cumsum(self.size[left] + self.size[right]) >> 19  # some half a million shingles at once
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(step)) + 1) if len(left) else ():
            both = []
            for side in (left[part], right[part]):
                n = self.size[side]
                e = np.repeat(self.first[side] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both.append(((np.repeat(np.arange(len(part), dtype=np.uint64), n) << KEY) | self.keys[e], self.w[e]))
            (ka, wa), (kb, wb) = both
            spot = np.searchsorted(kb, ka)
            spot[spot == len(kb)] = 0
            hit = np.flatnonzero(kb[spot] == ka) if len(kb) else np.zeros(0, np.int64)
            common = np.bincount((ka[hit] >> KEY).astype(np.int64), weights=np.minimum(wa[hit], wb[spot[hit]]), minlength=len(part))
            union = self.total[left[part]] + self.total[right[part]] - common
            ok[part] = (union > 0) & (common >= threshold * union - 1e-9)
        return ok


def _whole_links(least: int, ratio: float, shingle: int, idf, threshold: float):
    """Links of members of different labels within cells, verified on whole texts: a forest of edges between labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, ("family", "x", "y"), 1 << 20, "text"):
            vectors, label = Vectors(rows.column("text").to_pylist(), shingle, idf.value), rows.column("label").to_numpy()
            own, number = np.unique(label, return_inverse=True)
            root = np.arange(len(own))
            for i, j in _agreeing(rows, "family", least, ratio):
                for a in range(0, len(i), 1 << 12):  # pairs that became connected meanwhile need no look
                    p, q = i[a : a + (1 << 12)], j[a : a + (1 << 12)]
                    apart = root[number[p]] != root[number[q]]
                    p, q = p[apart], q[apart]
                    on = vectors.linked(p, q, threshold)
                    if on.any():
                        root = _merge(root, number[p[on]], number[q[on]])
            at = np.flatnonzero(root != np.arange(len(root)))
            yield _edges(own[at], own[root[at]])

    return run


def _verify(shingle: int, idf, threshold: float):
    """Linked pairs of blocks: rows (x, y, a, b, text) sorted by x, y, b hold a block's texts (b null), then its pairs."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        x, y, a = (rows.column(k).to_numpy().astype(np.int64) for k in ("x", "y", "a"))
        pair = rows.column("b").is_valid().to_numpy(zero_copy_only=False)
        block = np.cumsum(np.append(False, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else x
        b = rows.column("b").fill_null(0).to_numpy()
        at = np.flatnonzero(~pair)
        vectors = Vectors(rows.column("text").take(pa.array(at)).to_pylist(), shingle, idf.value)
        place = {k: r for r, k in enumerate(zip(block[at].tolist(), a[at].tolist(), strict=True))}
        own = block[pair].tolist()
        left, right = (np.array([place[k] for k in zip(own, v[pair].tolist(), strict=True)], np.int64) for v in (a, b))
        ok = vectors.linked(left, right, threshold)
        return _edges(a[pair][ok], b[pair][ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, ("x", "y"), 1 << 20, "text"):
            yield found(rows)

    return run


# --------------------------------------------------------------------------- operator


def _linked(pairs: DataFrame, docs: DataFrame, shingle: int, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of a written table whose weighted Jaccard similarity on whole texts reaches the threshold.

    Pairs are dealt to blocks by hashes of both ids; a text goes once to each block that has a pair of it, so a hub
    of many pairs meets them in many blocks, and a dense family costs its texts once per block, not per pair.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = max(1, -(-ids.count() // CELL))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    dealt = pairs.select(deal("a").alias("x"), deal("b").alias("y"), "a", "b")
    need = dealt.select("x", "y", F.explode(F.array("a", "b")).alias("a")).distinct()
    texts = docs.where(C.IdFilter(ids, "id").maybe("id")).select(F.col("id").alias("a"), "text")
    texts = C.merge_join(texts, need, "a").select("x", "y", "a", F.lit(None).cast("long").alias("b"), "text")
    rows = texts.union(dealt.withColumn("text", F.lit(None).cast("string")))
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", F.asc_nulls_first("b"))
    return C.map_arrow(rows, _verify(shingle, idf, threshold), "a long, b long")


def _cells(members: DataFrame, by: str, total: int, size: int) -> DataFrame:
    """Rows (by, id, label) of groups with several labels, dealt to cells (x, y) of about size by size members.

    Each two members of different labels of a group meet in one cell: members have a slot of their group by a hash of
    their id; those of the group's largest label meet all slots of others, these meet all slots.
    """
    parts = members.groupBy(by, "label").agg(F.count(F.lit(1)).alias("m"))
    torn = parts.groupBy(by).agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    torn = torn.select(by, "n", F.col("main.label").alias("main"), F.ceil((F.col("n") - F.col("main.m")) / size).cast("int").alias("few"), F.ceil(F.col("main.m") / size).cast("int").alias("many"))
    rows, ours = C.split_join(members, torn, [by], "n", total), F.col("label") == F.col("main")
    rows = rows.withColumn("slot", F.when(ours, F.col("few") + F.pmod(F.xxhash64("id"), "many")).otherwise(F.pmod(F.xxhash64("id"), "few")).cast("int"))
    rows = rows.withColumn("meets", F.sequence(F.lit(0), F.when(ours, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    return rows.select(by, "slot", "id", "label", "meets")


def _dealt(rows: DataFrame, by: str, *more: str) -> DataFrame:
    """Rows of _cells with what they carry, once for each cell, whole cells in order within a task."""
    rows = rows.withColumn("other", F.explode("meets")).select(by, F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "slot", "id", "label", *more)
    return rows.repartition(by, "x", "y").sortWithinPartitions(by, "x", "y", "slot")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """(id_col, class_id) for each row of docs: the smallest id of its near-duplicate class."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(base, "text", shingle))  # 4 MB at every size
    signs = C.written(C.map_arrow(base, _sign("id", "text", shingle, idf, bands, rows), "id long, c1 long, c2 long, total double, sig binary, band array<long>"), "signs")
    named = signs.where("id is not null")
    heads = named.groupBy("c1", "c2").agg(F.min(F.struct("id", "total", "sig", "band")).alias("h"), F.count(F.lit(1)).alias("copies"))
    heads = C.written(heads.select("c1", "c2", "copies", "h.*"), "heads")
    count = heads.count()
    least = int(round(bands * rows * (threshold - 0.24)))  # five deviations below the threshold
    ratio = threshold - 1e-6
    sig = heads.select("id", "total", "sig")

    # rows (key, id, hub) of buckets that hold two representatives at least
    dealt = heads.select("id", F.explode("band").alias("key"))
    full = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = C.written(C.split_join(dealt, full, ["key"], "n", count * bands), "shared")
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = C.merge_join(shared, score, "id").groupBy("key").agg(F.min(F.struct(-F.col("score"), "id")).alias("h"), F.count(F.lit(1)).alias("n"))
    hubs = C.written(hubs.select("key", F.col("h.id").alias("hub"), "n"), "hubs")

    # each member with the hub that it agrees with most
    stars = C.split_join(shared.drop("n"), hubs, ["key"], "n", count * bands).where("id <> hub")
    stars = C.written(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    centres = C.merge_join(stars.groupBy("b").agg(F.count(F.lit(1)).alias("n")), sig.select(F.col("id").alias("b"), F.col("total").alias("tb"), F.col("sig").alias("sig_b")), "b")
    pairs = C.merge_join(stars, sig.select(F.col("id").alias("a"), F.col("total").alias("ta"), F.col("sig").alias("sig_a")), "a")
    pairs = C.split_join(pairs, centres, ["b"], "n", stars.count()).where(F.least("ta", "tb") >= ratio * F.greatest("ta", "tb"))
    best = C.map_arrow(pairs.select("a", "b", "sig_a", "sig_b"), _agree(least), "a long, b long, agree int")
    best = best.groupBy("a").agg(F.max(F.struct("agree", -F.col("b"))).alias("h")).select("a", (-F.col("h.col2")).alias("b"))
    labels = connected_components(C.written(_linked(C.written(best, "pairs"), base, shingle, idf, threshold), "links"))

    # members of one bucket that aren't connected yet: those that agree enough form families
    def labelled(rows: DataFrame) -> DataFrame:
        return C.merge_join(rows, labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    open_ = C.written(labelled(shared.select("key", "id")), "open")
    cells = _dealt(C.merge_join(_cells(open_, "key", count * bands, CELL), sig, "id"), "key", "total", "sig")
    kin = connected_components(C.written(C.map_arrow(cells, _kin(least, ratio), EDGES).distinct(), "kin"))
    family = C.written(labelled(kin.select("id", F.col("label").alias("family"))), "families")
    cells = C.merge_join(_cells(family, "family", family.count(), CELL // 2), sig, "id")
    texts = base.where(C.IdFilter(family, "id").maybe("id")).dropDuplicates(["id"])
    cells = _dealt(C.merge_join(cells, texts, "id"), "family", "total", "sig", "text")
    late = C.written(C.map_arrow(cells, _whole_links(least, ratio, shingle, idf, threshold), EDGES).distinct(), "links")
    if not late.isEmpty():  # components of components
        joined = connected_components(late).select(F.col("id").alias("label"), F.col("label").alias("into"))
        fresh = C.merge_join(joined.select(F.col("label").alias("id"), F.col("into").alias("label")), labels, "id", "left_anti")
        labels = C.merge_join(labels, joined, "label", "left").select("id", F.coalesce("into", "label").alias("label"))
        labels = C.written(labels.union(fresh), "labels")

    classes = C.merge_join(heads.select("c1", "c2", "copies", "id"), labels, "id", "left").select("c1", "c2", "copies", F.coalesce("label", "id").alias("label"))
    out = C.split_join(named.select("id", "c1", "c2"), C.written(classes, "classes"), ["c1", "c2"], "copies", named.count())
    alone = signs.where("id is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias("class_id")).union(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row, of the smallest id, of each class; rows of a null id stay."""
    classes = near_duplicates(docs, id_col, text_col, **options).where(f"{id_col} is not null")
    classes = C.written(classes.groupBy(id_col).agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("times")), "classes")
    ids = docs.withColumn(id_col, F.col(id_col).cast("long"))
    kept = C.rows_but(ids, classes.where(f"{id_col} <> class_id"), id_col)
    twice = classes.where(f"times > 1 and {id_col} = class_id")
    if not twice.isEmpty():  # repeated rows of one id: one of them stays
        own = C.rows_of(kept, twice, id_col).dropDuplicates([id_col])
        kept = C.rows_but(kept, twice, id_col).unionByName(own)
    return kept.select(*docs.columns)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
