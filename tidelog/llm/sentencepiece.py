"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts are cut into words (a piece never spans the start of a run of word marks or a character that no piece
holds).  All distinct words of a batch advance together: from every character at once a trie of the pieces is
walked, which leaves the pieces that stand there; then, end position by end position, the best continuation of the
paths so far is taken among the pieces that end there by vectorised maxima, which store backpointers.

Models of both kinds are read.  For unigram models the maximum is that of the summed scores.  For BPE models a
sum of scores would give other pieces than merging does; there the maximum runs over the pieces that may follow
the path's last piece: a piece may follow if merging the two pieces' text alone keeps the seam between them (the
merges on both sides are undone, last first, and none may be overtaken by a merge across the seam).  Exactly one
path satisfies this, and it is the merge result, so ids equal those of the sentencepiece library.

Defined results: null and empty texts have no ids; characters that no piece holds become byte pieces (or the
unknown piece if the model has no bytes); decoding gives the normalised text (the word mark U+2581 itself reads
back as a space); null ids decode to an empty text; texts of any length are encoded whole.  Of other columns all
stay, but those that the operators make replace columns of the same name.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15 | 1)
_NONE = _U((1 << 64) - 1)
KEEPS = "sentencepiece"  # what workers keep between tasks
LONG = 256  # longer words (no white space for so long) are merged alone, by heap
BATCH = 1 << 16  # characters of the words that are searched together; a longer word stands alone

codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; varints as int, all else as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """A parsed .model file with the tables that encoding and decoding probe."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix, charsmap, squeeze, self.suffix = UNIGRAM, True, b"", True, False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.kind = own.get(3, UNIGRAM)
                self.suffix = bool(own.get(24, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap or self.suffix:
            raise ValueError("only unigram and BPE models without a character map and with word marks in front are read")
        self.squeeze = squeeze
        n = len(self.pieces)
        types = np.array(self.types)
        self.unk = int(np.flatnonzero(types == UNKNOWN)[0])
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(types == BYTE).tolist()}
        usable = [i for i in range(n) if self.types[i] in (NORMAL, USER) and self.pieces[i]]
        self.id_of = {self.pieces[i]: i for i in usable}
        self.chars = {c for i in usable for c in self.pieces[i]}
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("pieces span words")
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.score = np.array(self.scores, np.float64)
        self.len = np.array([len(p) for p in self.pieces], np.int64)
        self.powers = np.full(self.longest + 2, _B, _U)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.hash = np.zeros(n, _U)
        for length in set(self.len[usable].tolist()):
            own = [i for i in usable if len(self.pieces[i]) == length]
            self.hash[own] = self._prefixes([self.pieces[i] for i in own], length)[:, -1]
        ids = np.array(usable)
        order = np.argsort(self.hash[ids])
        self.keys, self.key_ids = self.hash[ids][order], ids[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("piece keys collide")
        self.seen = np.zeros(1 << 20, bool)  # the keys' first 20 bits
        self.seen[(self.keys >> _U(44)).astype(np.int64)] = True
        low = min(self.scores[i] for i in usable)
        self.unk_score = low - 10.0
        self.out = [b"" if t in (CONTROL, UNUSED) else (" \u2047 ".encode() if t == UNKNOWN else (bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode())) for p, t in zip(self.pieces, self.types, strict=True)]
        blank = re.escape(MARK)
        self.words = re.compile(f"\n|{blank}+[^{blank}\n]*|[^{blank}\n]+") if "\n" not in self.chars else re.compile(f"{blank}+[^{blank}]*|[^{blank}]+")
        if self.kind == BPE:
            self._splits(usable)
        self._trie([i for i in usable if self.kind != BPE or self.made[i]])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair_keys, self.pair_ok = np.full(1 << 20, (1 << 64) - 1, _U), np.zeros(1 << 20, bool)  # answers of may_follow, one per place

    def _prefixes(self, words: list[str], length: int) -> np.ndarray:
        """Prefix hashes of words of one length, one row each."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
        out = np.zeros((len(words), length + 1), _U)
        values = C.mix(codes.astype(_U) + _U(1))
        for i in range(length):
            out[:, i + 1] = out[:, i] * _B + values[:, i]
        return out

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, or -1."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        if len(maybe):
            own = h[maybe]
            at = np.searchsorted(self.keys, own)
            at[at == len(self.keys)] = 0
            out[maybe] = np.where(self.keys[at] == own, self.key_ids[at], -1)
        return out

    # ------------------------------------------------------------------ merging

    def merge(self, word: str) -> list[tuple[int, int, int]]:
        """Merge a word's characters, best score first, leftmost of equals; (id or -1, start, end) each."""
        return self._merged(word)[0]

    def _merged(self, word: str) -> tuple[list[tuple[int, int, int]], tuple[int, int] | None]:
        n = len(word)
        end, before, last = list(range(1, n + 1)), list(range(-1, n - 1)), None
        id_of, scores, heap = self.id_of, self.scores, []

        def offer(a: int, b: int) -> None:
            i = id_of.get(word[a : end[b]]) if end[b] - a <= self.longest else None
            if i is not None:
                heapq.heappush(heap, (-scores[i], a, end[a], end[b], i))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, mid, stop, _ = heapq.heappop(heap)
            if end[a] != mid or mid >= n or end[mid] != stop:
                continue
            last = (a, mid, stop)
            end[a], end[mid] = stop, -1
            if stop < n:
                before[stop] = a
                offer(a, stop)
            if before[a] >= 0:
                offer(before[a], a)
        out, a = [], 0
        while a < n:
            out.append((id_of.get(word[a : end[a]], -1), a, end[a]))
            a = end[a]
        return out, last

    def _splits(self, usable: list[int]) -> None:
        """For each piece the two pieces of its last merge, the rank of that merge, and whether it can be made at all."""
        n = len(self.pieces)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n + 1, -1)
        self.made = np.zeros(n, bool)
        by_score = sorted({self.scores[i] for i in usable}, reverse=True)
        place = {s: r for r, s in enumerate(by_score)}
        seen: dict[float, int] = {}
        for i in usable:
            p = self.pieces[i]
            if len(p) == 1:
                self.made[i] = True
                continue
            parts, last = self._merged(p)
            if len(parts) == 1:
                self.made[i] = True
                self.left[i], self.right[i] = self.id_of.get(p[: last[1]], -1), self.id_of.get(p[last[1] :], -1)
                self.rank[i] = place[self.scores[i]]
            seen[self.scores[i]] = seen.get(self.scores[i], 0) + 1
        # words that hold the text of pieces of equal scores are merged, not searched
        self.tied = [self.pieces[i] for i in usable if len(self.pieces[i]) > 1 and seen[self.scores[i]] > 1]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the seam between pieces a and b outlives merging their text; -1 stands for an unknown character."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        pair = (a[at].astype(_U) << _U(32)) | b[at].astype(_U)
        place = (C.mix(pair) >> _U(44)).astype(np.int64)
        told = self.pair_keys[place] == pair
        out[at[told]] = self.pair_ok[place[told]]
        at, pair, place = at[~told], pair[~told], place[~told]
        if len(at):
            out[at] = ok = self._may_follow(a[at], b[at])
            self.pair_keys[place] = pair
            order = np.flatnonzero(self.pair_keys[place] == pair)  # of pairs at one place one remains
            self.pair_ok[place[order]] = ok[order]
        return out

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(at), len(self.pieces) + 1)
        while len(at):
            size = self.len[a] + self.len[b]
            both = np.full(len(at), -1)
            fit = size <= self.longest
            both[fit] = self.probe(self.hash[a[fit]] * self.powers[self.len[b[fit]]] + self.hash[b[fit]])
            bad = (both >= 0) & (np.where(both >= 0, self.rank[both], 0) < limit) & (both >= 0)
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            lost = (a < 0) | (b < 0)  # a part that is no piece (unknown to the model) can't merge further
            if lost.any():
                at, a, b, limit = at[~lost], a[~lost], b[~lost], limit[~lost]
        return out

    # ------------------------------------------------------------------ search

    def _trie(self, ids: list[int]) -> None:
        """A trie of these pieces: steps (node, character) in a table with linear probing, and the piece that ends at each node or -1."""
        steps, ends = {}, [-1]
        for i in ids:
            node = 0
            for c in self.pieces[i]:
                step = node << 21 | ord(c)
                node = steps.get(step, 0)
                if not node:
                    node = steps[step] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int32)
        bits = (4 * len(ends)).bit_length()
        self.shift = _U(64 - bits)
        self.steps, self.nodes = np.full(1 << bits, _NONE, _U), np.zeros(1 << bits, np.int32)
        keys, nodes = np.fromiter(steps, _U, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        place = (keys * _B >> self.shift).astype(np.int64)
        while len(keys):
            free = self.steps[place] == _NONE
            self.steps[place[free]] = keys[free]  # of several at one place one stays, the others move on
            stays = self.steps[place] == keys
            self.nodes[place[stays]] = nodes[stays]
            keys, nodes, place = keys[~stays], nodes[~stays], place[~stays] + 1 & (1 << bits) - 1

    def _step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The trie's next nodes, 0 where there is none."""
        key = nodes.astype(_U) << _U(21) | codes
        place = (key * _B >> self.shift).astype(np.int64)
        there = self.steps[place]
        found = there == key
        out = np.where(found, self.nodes[place], 0)
        far = np.flatnonzero(~found & (there != _NONE))
        while len(far):
            place[far] = at = place[far] + 1 & len(self.steps) - 1
            there = self.steps[at]
            found = there == key[far]
            out[far[found]] = self.nodes[at[found]]
            far = far[~found & (there != _NONE)]
        return out

    def _standing(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, length, id) of all pieces that stand in the words; characters that are no piece have the id -1.

        left: the number of characters from each one to its word's end.
        """
        starts, sizes, found = [], [], []
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        for size in range(1, self.longest + 1):
            node = self._step(node, codes[at + (size - 1)])
            ids = self.ends[node]
            is_ = np.flatnonzero(ids >= 0) if size > 1 else slice(None)
            starts.append(at[is_])
            found.append(ids[is_])
            sizes.append(np.full(len(starts[-1]), size))
            go = np.flatnonzero((node > 0) & (left[at] > size))
            at, node = at[go], node[go]
            if not len(at):
                break
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(found)

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The paths of words: (piece ids, -1 for an unknown character, of all words in order; where each piece ends in its word; how many each word has)."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(length)
        word = np.repeat(np.arange(n), length)
        start, size, ids = self._standing(codes, stop[word] - np.arange(len(codes)))
        # a word of k characters has k + 1 seams: the one before character c of word w is c + w
        a = start + word[start]
        b = a + size
        zero = stop - length + np.arange(n)
        end = b - zero[word[start]]
        most = int(length.max())
        order = np.argsort(end.astype(np.uint16) if most < 1 << 16 else end, kind="stable")
        a, b, ids = a[order], b[order], ids[order]
        ends = np.searchsorted(end[order], np.arange(1, most + 2))
        last = np.full(len(codes) + n, -1, np.int32)  # single characters are candidates, so every seam gets a path
        back = np.full(len(last), len(last))
        best = np.full(len(last), -np.inf)
        best[zero] = 0
        for lo, hi in zip(ends.tolist(), ends[1:].tolist()):
            x, y, i = a[lo:hi], b[lo:hi], ids[lo:hi]
            if self.kind == BPE:
                ok = np.flatnonzero(self.may_follow(last[x], i))
                x, y, i = x[ok], y[ok], i[ok]
                value = best[x] + 1
            else:
                value = best[x] + np.where(i >= 0, self.score[i], self.unk_score)
            np.maximum.at(best, y, value)
            top = np.flatnonzero(value == best[y])
            x, y, i = x[top], y[top], i[top]
            np.minimum.at(back, y, x)  # of equal values the longest piece
            top = np.flatnonzero(x == back[y])
            last[y[top]] = i[top]
        on = np.zeros(len(last), bool)
        first = np.zeros(len(last), bool)
        first[zero] = True
        at = zero + length
        while len(at):
            on[at] = True
            at = back[at]
            at = at[~first[at]]
        seams = np.flatnonzero(on)
        count = np.diff(np.searchsorted(seams, zero), append=len(seams))
        return last[seams], seams - np.repeat(zero, count), count

    def _blob(self, word: str, path: list[tuple[int, int, int]]) -> bytes:
        ids: list[int] = []
        unknown = False
        for i, a, b in path:
            if i >= 0:
                ids.append(i)
            elif self.bytes_:
                ids.extend(self.bytes_[x] for x in word[a:b].encode("utf-8", "surrogatepass"))
            elif not unknown:
                ids.append(self.unk)
            unknown = i < 0
        return np.array(ids, np.int32).tobytes()

    def learn(self, words: set[str], most: int = 50_000) -> None:
        """Encode words that the cache doesn't hold; the cache has two generations of ``most`` words."""
        if len(self.cache) > most:
            self.old, self.cache = self.cache, {}
        again = words & self.old.keys()
        for w in again:
            self.cache[w] = self.old[w]
        rest = list(words - again)
        if self.kind == BPE:
            tied = [t for t in self.tied if t[0] != MARK]
            alone = [w for w in rest if len(w) > LONG or MARK + MARK in w or (tied and any(t in w for t in tied))]
            for w in alone:
                self.cache[w] = self._blob(w, self.merge(w))
            if alone:
                rest = list(words.difference(again, alone))
        till = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))
        hi = 0
        while hi < len(rest):
            lo = hi
            hi = max(lo + 1, int(np.searchsorted(till, (till[lo - 1] if lo else 0) + BATCH, side="right")))
            part = rest[lo:hi]
            ids, ends, count = self.search(part)
            stop = np.cumsum(count)
            raw, to = ids.tobytes(), (4 * stop).tolist()
            self.cache.update(zip(part, map(raw.__getitem__, map(slice, [0, *to], to)), strict=False))
            for r in np.unique(np.searchsorted(stop, np.flatnonzero(ids < 0), side="right")).tolist():
                mine = slice(int(stop[r] - count[r]), int(stop[r]))
                to = ends[mine].tolist()
                self.cache[part[r]] = self._blob(part[r], list(zip(ids[mine].tolist(), [0, *to[:-1]], to, strict=True)))

    def forget(self) -> None:
        """Drop the words that the cache holds; the tables stay."""
        self.cache, self.old = {}, {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        words = [self.words.findall(self.normalise(t or "")) for t in texts]
        new: set[str] = set()
        for w in words:
            new.update(w)
        fresh = new.difference(self.cache)
        if fresh:
            self.learn(fresh)
            if lost := new.difference(self.cache):  # a generation ended: what this batch needs is kept
                self.learn(lost, most=1 << 62)
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        if ids is None or len(ids) == 0:
            return ""
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode("utf-8", "each-byte")
        return text[1:] if self.prefix and text[:1] == " " else text


def _model(data: bytes) -> Model:
    """The model of this worker; its tables outlive a task of this operator, its cached words don't.

    An executor may have more workers than cores (a stage with two Python steps leaves two a core), and tasks go
    through all of them in turn, so what a worker keeps counts for idle ones too.
    """
    models: dict[bytes, Model] = C.kept(KEEPS, dict)
    if data not in models:
        models.clear()
        models[data] = Model(data)
    return models[data]


# --------------------------------------------------------------------------- operators


def model_bytes(path: str = MODEL) -> bytes:
    """A model file on the driver; its size (some 0.5 MB) is fixed and travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with ``token_ids`` array<int> and ``n_tokens`` long; decoded names a column for what the ids decode to.

    The worker that encodes also decodes, so that a task needs one process with the model's tables.
    """
    docs = C.without(docs, "token_ids", "n_tokens", *([decoded] if decoded else []))
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        try:
            for b in batches:
                for part in C.slices(b, text_col, 1 << 20):
                    blobs = m.encode(part.column(text_col).to_pylist())
                    sizes = np.fromiter((len(x) // 4 for x in blobs), np.int64, len(blobs))
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
                    more = {decoded: pa.array([m.decode(np.frombuffer(x, np.int32)) for x in blobs], pa.string())} if decoded else {}
                    yield C.put(part, token_ids=ids, n_tokens=pa.array(sizes), **more)
        finally:
            m.forget()

    return C.map_arrow(docs, run, schema, KEEPS)


def decode(tokens: DataFrame, model: bytes, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """tokens with the text of ``ids_col``."""
    tokens = C.without(tokens, to)
    schema = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            col = b.column(ids_col)
            col = col.cast(pa.list_(pa.int32())) if not pa.types.is_list(col.type) else col
            values = col.values.to_numpy(zero_copy_only=False)
            offsets, nulls = col.offsets.to_numpy(), col.is_null().to_numpy(zero_copy_only=False)
            out = [None if nulls[i] else m.decode(values[offsets[i] : offsets[i + 1]]) for i in range(len(col))]
            yield C.put(b, **{to: pa.array([x or "" for x in out], pa.string())})

    return C.map_arrow(tokens, run, schema, KEEPS)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, model, decoded="decoded")
    same = F.translate(F.coalesce("text", F.lit("")), MARK, " ") == F.col("decoded")
    return both.select("doc_id", "n_tokens", "token_ids", same.alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))
