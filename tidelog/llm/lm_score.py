"""Cross-entropy difference (Moore and Lewis) between a target and a background bigram model.

The target corpus is what the caller hands over (the query: documents labelled good and not toxic), the
background all documents.  Words and bigrams of both corpora are counted whole, in tables that grow with the
corpus: shards of all keys (55 bits identify a word or bigram) add up what chunks of documents count, and send each
chunk the totals of its own keys.  With a ``size``, both
models share a vocabulary of that size instead: the most frequent words of all documents, and a class for each kind
and length of other words.  The models are matched: of one order, with one smoothing (Dirichlet, towards add-one
unigrams), the background's counts scaled to the target's size.

A document's score is the mean over its words of target loss less background loss, in nats: the lower, the more
it is like the target.

Defined results: a document without a word (null and empty texts too) has no words and score 0; without a target
corpus both models are the background's and every score is 0; null ids are scored like others; repeated rows
count and are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

_U = np.uint64
CLASSES = 12  # kinds (plain, capitals, with a digit, not ASCII) x lengths (to 4, to 9, longer)
_CASE = np.zeros(256, np.int8)
_CASE[65:91] = 1
_CASE[48:58] = 2
_CASE[128:] = 4
_FOLD = C._BYTE.copy()
_FOLD[65:91] = C._BYTE[97:123]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its class as an unknown word, first word of each text with the total appended)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    isw = C._IS_WORD[buf]
    edge = np.flatnonzero(np.diff(isw.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    p, q = C._powers(len(buf))
    cum = np.empty(len(buf) + 1, _U)
    cum[0] = 0
    np.cumsum(_FOLD[buf] * p, out=cum[1:])
    h = C.mix((cum[ends] - cum[starts]) * q[starts])
    case = _CASE[buf]
    count = lambda bit: np.concatenate([[0], np.cumsum((case & bit) > 0, dtype=np.int32)])
    upper, digit, wide = (count(b) for b in (1, 2, 4))
    size = ends - starts
    kind = np.where(wide[ends] > wide[starts], 3, np.where(digit[ends] > digit[starts], 2, ((upper[ends] - upper[starts] == size) & (size > 1)).astype(np.int64)))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    return h, kind * 3 + (size > 4) + (size > 9), np.searchsorted(starts, bounds)


class Vocabulary:
    """Ids of words: 0 begins a text, then the classes of unknown words, then the words."""

    def __init__(self, hashes: np.ndarray, size: int):
        self.words, self.size = np.sort(hashes.astype(np.int64).view(_U)), size

    def ids(self, h: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return 1 + unknown
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == h, at + 1 + CLASSES, 1 + unknown)

    def bigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word with the one before it, first word of each text with the total appended)."""
        h, unknown, first = tokens(texts)
        ids = self.ids(h, unknown)
        before = np.zeros(len(ids), np.int64)
        before[1:] = ids[:-1]
        begin = first[:-1][np.diff(first) > 0]
        before[begin] = 0
        return before * self.size + ids, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by word hash of a whole task, summed before they leave it."""
    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal keys, counts
        k = np.concatenate([keys, *[w[0] for w in waiting]])
        n = np.concatenate([counts, *[w[1] for w in waiting]])
        keys, where = np.unique(k, return_inverse=True)
        counts = np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)
        waiting.clear()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for b in C.slices(batch, "text"):
            waiting.append(np.unique(tokens([t or "" for t in b.column("text").to_pylist()])[0], return_counts=True))
            if sum(len(w[0]) for w in waiting) > 1 << 20:
                merge()
                if len(keys) > 1 << 21:  # bounded memory: what is summed so far leaves
                    yield rows()
                    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    if waiting:
        merge()
    yield rows()


def vocabulary(docs: DataFrame, size: int = 2048, text_col: str = "text") -> Vocabulary:
    """The most frequent words of all documents; size includes the unknown classes and the beginning."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size - 1 - CLASSES)
    return Vocabulary(np.array([r["word"] for r in top.toLocalIterator()], np.int64), size)


def bigram_counts(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> np.ndarray:
    """Exact counts of all bigrams, a row for each word before."""
    cells = vocab.size * vocab.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(cells, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for b in C.slices(batch, "text"):
                code, times = np.unique(vocab.bigrams([t or "" for t in b.column("text").to_pylist()])[0], return_counts=True)
                counts[code] += times
        if n:
            yield C.partial_table(counts, n)

    table, _ = C.summed_table(docs.select(F.col(text_col).alias("text")).mapInArrow(run, C.TABLE), cells)
    return table.reshape(vocab.size, vocab.size)


def losses(counts: np.ndarray, total: float, mu: float = 200.0) -> np.ndarray:
    """-ln P(word | word before) of the smoothed model, with the counts scaled to total words."""
    have = counts.sum()
    if not have:
        return np.full(counts.shape, np.log(counts.shape[0]), np.float32)
    scale = total / have
    c = counts * scale
    unigram = c.sum(0) + 1.0
    unigram /= unigram.sum()
    p = (c + mu * unigram) / (c.sum(1, keepdims=True) + mu)
    return (-np.log(p)).astype(np.float32)


# --------------------------------------------------------------------------- the whole vocabulary

ENTRIES = "chunk long, shard int, far boolean, keys binary, n binary, m binary"
TOLD = "chunk long, shard int, words long, near long, far long, told binary"


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, lowest bytes first, compressed."""
    for t in (np.uint8, np.uint16, np.uint32, np.uint64):
        if not len(x) or int(x.max()) <= np.iinfo(t).max:
            return np.dtype(t).char.encode() + zlib.compress(x.astype(t).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)
    raise AssertionError


def _unpack(b: bytes) -> np.ndarray:
    t = np.dtype(b[:1].decode())
    return np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(t.itemsize, -1).T.copy().view(t).ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and their gaps, each in as many bytes as the widest takes."""
    gaps = np.diff(keys)
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].tobytes() + bytes([wide]) + gaps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack_keys(b: bytes) -> np.ndarray:
    wide = b[8]
    gaps = np.zeros(((len(b) - 9) // wide, 8), np.uint8)
    gaps[:, :wide] = np.frombuffer(b, np.uint8, offset=9).reshape(-1, wide)
    return np.cumsum(np.concatenate([np.frombuffer(b, _U, 1), gaps.view(_U).ravel()]))


def _key(x: np.ndarray, word: bool) -> np.ndarray:
    """Keys have 56 bits; those of words (and of the beginning, whose hash is 0) are odd, those of bigrams even."""
    return (C.mix(x ^ _U(0x5851F42D4C957F2D if word else 0)) >> _U(8)) & ~_U(1) | _U(word)


BEGIN = _key(np.zeros(1, _U), True)[0]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so sorted keys are sorted by shard."""
    return ((keys >> _U(24)) * _U(shards) >> _U(32)).astype(np.int64)


class Chunk:
    """Some texts as hashes of their distinct words, the number of each word, and the first word of each text."""

    def __init__(self, hashes: np.ndarray, word: np.ndarray, first: np.ndarray):
        self.hashes, self.word, self.first = hashes, word, first

    @classmethod
    def of(cls, texts: list[str]) -> Chunk:
        parts = [tokens(texts[lo:hi])[::2] for lo, hi in C.chunks(texts)]
        h, sizes = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((_U, [p[0] for p in parts]), (np.int64, [np.diff(p[1]) for p in parts])))
        hashes, word, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(hashes[order], place[word], np.concatenate([[0], np.cumsum(sizes)]))

    def pack(self) -> list[bytes]:
        return [self.hashes.tobytes(), _pack(self.word), _pack(np.diff(self.first))]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Chunk:
        return cls(np.frombuffer(packed[0], _U), _unpack(packed[1]), np.concatenate([[0], np.cumsum(_unpack(packed[2]))]))

    def number(self) -> Chunk:
        """The sorted distinct keys of words and bigrams with their counts, and where each word's keys are among them."""
        size = np.diff(self.first)
        self.begins, ends = self.first[:-1][size > 0], self.first[1:][size > 0] - 1
        h = self.hashes[self.word]
        before = np.append(_U(0), h[:-1])[: len(h)]
        before[self.begins] = 0
        pairs, pair_at, pair_n = np.unique(_key(before * _U(C._BASE) + h, False), return_inverse=True, return_counts=True)
        words = _key(self.hashes, True)
        word_n = np.bincount(self.word, minlength=len(words))
        after = word_n - np.bincount(self.word[ends], minlength=len(words))  # times a word stands before another
        every = np.concatenate([pairs, words, [BEGIN]])
        self.keys, at = np.unique(every, return_inverse=True)  # words that share a key are one word
        self.n = np.bincount(at, weights=np.concatenate([pair_n, word_n, [0]])).astype(np.int64)
        self.m = np.bincount(at, weights=np.concatenate([np.zeros(len(pairs)), after, [len(self.begins)]])).astype(np.int64)
        self.pair_key, self.word_key, self.begin = at[pair_at], at[len(pairs) : -1][self.word], int(at[-1])
        return self

    def entries(self, chunk: int, shards: int, far: bool) -> Iterator[pa.RecordBatch]:
        """ENTRIES of this chunk, one row for each shard that it has keys of."""
        cuts = np.searchsorted(_shard(self.keys, shards), np.arange(shards + 1))
        own = np.flatnonzero(np.diff(cuts)).tolist()
        for lo in range(0, len(own), 64):
            part = own[lo : lo + 64]
            cols = [[f(x[cuts[k] : cuts[k + 1]]) for k in part] for f, x in ((_pack_keys, self.keys), (_pack, self.n), (_pack, self.m))]
            arrays = [pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([far] * len(part)), *[pa.array(c, pa.binary()) for c in cols]]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENTRIES.split(", ")])


def _chunks_of(batches: Iterator[pa.RecordBatch], text_col: str, chunk_words: int) -> Iterator[tuple[Chunk, pa.Table]]:
    held, size = [], 0
    for batch in batches:
        for b in C.slices(batch, text_col):
            held.append(b)
            size += b.column(text_col).nbytes
            if size >= 6 * chunk_words:
                rows = pa.Table.from_batches(held)
                yield Chunk.of([t or "" for t in rows.column(text_col).to_pylist()]), rows
                held, size = [], 0
    if held:
        rows = pa.Table.from_batches(held)
        yield Chunk.of([t or "" for t in rows.column(text_col).to_pylist()]), rows


def _pack_chunks(text_col: str, keep: list[str], chunk_words: int):
    """(chunk, recipe) of the documents: the packed chunk and the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for made, rows in _chunks_of(batches, text_col, chunk_words):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.select(keep).schema) as out:
                out.write_table(rows.select(keep))
            recipe = pickle.dumps((zlib.compress(sink.getvalue(), 1), made.pack()), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([recipe], pa.binary())], names=["chunk", "recipe"])
            number += 1

    return run


def _entries_of_chunks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, recipe in zip(b.column("chunk").to_pylist(), b.column("recipe"), strict=True):
                yield from Chunk.unpack(pickle.loads(recipe.as_py())[1]).number().entries(chunk, shards, True)

    return run


def _entries_of_texts(text_col: str, shards: int, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, _ in _chunks_of(batches, text_col, chunk_words):
            yield from made.number().entries(-1, shards, False)

    return run


def _total(rows: pa.Table) -> pa.Table:
    """Totals of a shard's keys in both corpora: one row of them all, and one for each chunk of the documents."""
    keys = [_unpack_keys(x) for x in rows.column("keys").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    far = np.array(rows.column("far").to_pylist(), bool)
    of_far = np.repeat(far, np.diff(cuts))
    total = {}
    for name in ("n", "m"):
        x = np.concatenate([_unpack(v) for v in rows.column(name).to_pylist()])
        for side, on in (("near", ~of_far), ("far", of_far)):
            total[name, side] = np.bincount(where[on], weights=x[on], minlength=len(every)).astype(np.int64)
    word = (every & _U(1)) == 1
    near, all_ = (int(total["n", k][word].sum()) for k in ("near", "far"))
    words = int((word & (total["n", "near"] + total["n", "far"] > 0)).sum())
    shard = rows.column("shard")[0].as_py()
    out = [{"chunk": None, "shard": shard, "words": words, "near": near, "far": all_, "told": None}]
    for i in np.flatnonzero(far).tolist():
        at = where[cuts[i] : cuts[i + 1]]
        told = pickle.dumps([_pack(total[name, side][at]) for name in ("n", "m") for side in ("near", "far")], protocol=5)
        out.append({"chunk": rows.column("chunk")[i].as_py(), "shard": shard, "words": 0, "near": 0, "far": 0, "told": told})
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_pylist(out, pa.schema(list(zip([x.split()[0] for x in TOLD.split(", ")], kinds, strict=True))))


def _scored(known: dict[str, int], words: int, mu: float, schema: pa.Schema):
    def run(recipe: pa.Table, told: pa.Table) -> pa.Table:
        rows, packed = pickle.loads(recipe.column("recipe")[0].as_py())
        rows = pa.ipc.open_stream(zlib.decompress(rows)).read_all()
        own = Chunk.unpack(packed).number()
        parts = [pickle.loads(x) for x in told.sort_by("shard").column("told").to_pylist()]
        count = {k: np.concatenate([_unpack(p[i]) for p in parts]).astype(np.float64) for i, k in enumerate(("n near", "n far", "m near", "m far"))}
        word, pair = own.word_key, own.pair_key
        before = np.append(own.begin, word[:-1])[: len(word)]
        before[own.begins] = own.begin
        total = float(known["near"] or known["far"])
        n = np.diff(own.first)
        mean = []
        for side in ("near" if known["near"] else "far", "far"):
            scale = total / known[side] if known[side] else 0.0
            unigram = (count[f"n {side}"][word] * scale + 1.0) / (total * (known[side] > 0) + words)
            loss = -np.log((count[f"n {side}"][pair] * scale + mu * unigram) / (count[f"m {side}"][before] * scale + mu))
            sums = np.zeros(len(n))
            sums[n > 0] = np.add.reduceat(loss, own.begins) if len(own.begins) else 0.0
            mean.append(sums / np.maximum(n, 1))
        made = {"n_words": pa.array(n), "target_loss": pa.array(mean[0]), "background_loss": pa.array(mean[1]), "ced": pa.array(mean[0] - mean[1])}
        for k, v in made.items():
            rows = rows.append_column(k, v)
        return rows.cast(schema)

    return run


def score_whole(docs: DataFrame, target: DataFrame, text_col: str, keep: list[str], mu: float = 200.0, chunk_words: int = 1 << 20) -> DataFrame:
    """Scores with all words and bigrams: chunks of texts send their distinct keys to shards, which send totals back.

    Of a chunk, each distinct word or bigram moves once each way, however often it occurs, and numbers of words
    once; a shard holds the counts of its range of keys, whose number grows with the documents.
    """
    shards = max(8, 2 * docs.rdd.getNumPartitions())
    recipes = C.written(docs.mapInArrow(_pack_chunks(text_col, keep, chunk_words), "chunk long, recipe binary"), "chunks")
    entries = recipes.mapInArrow(_entries_of_chunks(shards), ENTRIES).union(target.select(text_col).mapInArrow(_entries_of_texts(text_col, shards, chunk_words), ENTRIES))
    told = C.written(entries.groupBy("shard").applyInArrow(_total, TOLD), "told")
    all_ = told.where("chunk is null").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("words", "near", "far")]).first()
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("n_words", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in MADE[1:]]])
    run = _scored({k: all_[k] for k in ("near", "far")}, all_["words"], mu, to_arrow_schema(schema))
    return recipes.groupBy("chunk").cogroup(told.where("chunk is not null").select("chunk", "shard", "told").groupBy("chunk")).applyInArrow(run, schema)


MADE = ("n_words", "target_loss", "background_loss", "ced")


def score(docs: DataFrame, target: DataFrame, text_col: str = "text", size: int | None = None, with_text: bool = True, chunk_words: int = 1 << 20) -> DataFrame:
    """docs with ``n_words``, ``target_loss``, ``background_loss`` (per word) and ``ced``, their difference.

    target holds the texts of the target corpus in a column of the same name; without with_text they aren't returned.
    All words count; with a size, a vocabulary of that size and classes of other words.
    """
    made = MADE
    docs = C.without(docs, *made)
    if size is None:
        return score_whole(docs, target, text_col, [c for c in docs.columns if with_text or c != text_col], chunk_words=chunk_words)
    vocab = vocabulary(docs, size, text_col)
    ahead, back = bigram_counts(target, vocab, text_col), bigram_counts(docs, vocab, text_col)
    if not ahead.sum():
        ahead = back
    total = float(ahead.sum())
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, losses(ahead, total).ravel(), losses(back, total).ravel()))  # 8 bytes x size^2
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in made[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, near, far = shared.value
        for batch in batches:
            for b in C.slices(batch, text_col):
                code, first = own.bigrams([t or "" for t in b.column(text_col).to_pylist()])
                n = np.diff(first)
                mean = []
                for table in (near, far):
                    cum = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
                    mean.append((cum[first[1:]] - cum[first[:-1]]) / np.maximum(n, 1))
                yield C.put(b, n_words=pa.array(n), target_loss=pa.array(mean[0]), background_loss=pa.array(mean[1]), ced=pa.array(mean[0] - mean[1]))

    return docs.mapInArrow(run, schema)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    rounded = [F.round(k, 5).alias(k) for k in ("target_loss", "background_loss", "ced")]
    return score(docs, C.rows_of(docs, good, "doc_id"), with_text=False).select("doc_id", "n_words", *rounded)
