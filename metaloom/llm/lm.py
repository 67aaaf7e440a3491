"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(half 1 | class, history) * ... * P(word | leaf). The class of a
word is the band of its corpus count (one class holds the words met at most once and a place for unknown
words, one the end token); the bits of its hash split a class into nested halves, more for a band of more
words, so that a leaf holds few. Each of these softmaxes (over all classes, then over two halves) starts
from its node's shares of tokens and adds three hashed features: the node with the last word, with the word
before it (a skip), and with both. In a leaf a word has its share of the leaf's tokens.

Training: ``ROUNDS`` gradient updates. Documents are dealt to the rounds by a hash of their id; in each
round the tasks sum the observed and the expected counts of all features over that round's documents under
the shared weights, and the driver moves each weight along its gradient, divided by a bound of its
curvature. All sums run over the corpus, so file layout and parallelism do not change the model; every
training token is in one round. Scoring adds rows of weights in sparse numpy batches.

The corpus is read once into chunks of at most ``CHUNK_TOKENS`` tokens (or one text): texts as numbers of
the chunk's dictionary. Corpus counts of words are added up in ``SLICES`` by hash and go back to the chunks
that asked: no task holds the corpus dictionary. What is broadcast are the weights, whose rows grow with
the cube root of the training tokens (``rows_for``), and the leaves' totals, whose number grows with the
vocabulary. Words are told apart by 64 bits of hash.

Edge cases: a null or empty text is its end token alone; without training texts every count is zero and
the score is that of unknown words; a null id counts as training (remainder 0); rows that repeat an id are
rows of their own; ids are of any type; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, pieces, strings

ROUNDS, RATE, DAMP = 8, 0.4, (4.0, 1.0)  # of classes and of halves
BANDS, TEMPLATES, NEVER = 14, 3, 30.0
MIN_ROWS, BLOCK, CLASS_SHARE = 1 << 16, 1 << 15, 32  # weights of a template; of a block; how many times fewer rows the classes have
CHUNK_TOKENS, PART_TOKENS, BATCH, CLASS_BATCH, SLICES = 1_000_000, 250_000, 65_536, 8192, 512
PART_CHUNKS = 4096  # whose arrays of a slice are added up at once
END = b""
_ODD = np.uint32(0x9E3779B1)


def tag_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def rows_for(tokens: int) -> int:
    """A template's weights of halves: a power of two that grows with the cube root of the training tokens."""
    return max(MIN_ROWS, 1 << round(math.log2(max(1, tokens)) / 3 + 9))


# ---------------------------------------------------------------- packed arrays


def pack(x: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers as the bytes that differ from zero, lowest first; of an ordered array its steps."""
    x = x.astype(np.uint64)
    x = np.diff(x, prepend=np.uint64(0)) if ordered else x
    planes = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return len(x).to_bytes(4, "little") + z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()) + z.flush()


def unpack(data: bytes, ordered: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zlib.decompress(data[4:], -15), np.uint8)
    x = np.zeros((n, 8), np.uint8)
    if len(raw):
        x[:, : len(raw) // n] = raw.reshape(-1, n).T
    x = x.view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ordered else x


def _squeeze(flat: np.ndarray) -> bytes:
    return len(flat).to_bytes(4, "little") + pa.compress(flat.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32)


# ---------------------------------------------------------------- chunks and corpus counts


class _Numbers(dict):
    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def chunks(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: a row for each chunk with its texts, ordered by round, and its dictionary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def flush(chunk: int, docs_: list[tuple], numbers: _Numbers, at: pa.DataType) -> pa.RecordBatch:
        docs_.sort(key=lambda d: d[2])
        ids, held, rounds, texts = zip(*docs_)
        tags, number = np.unique(np.fromiter(map(tag_of, numbers), np.uint64, len(numbers)), return_inverse=True)
        size, held, flat = np.array([len(t) for t in texts]), np.array(held, bool), number.astype(np.int32)[np.concatenate(texts)]
        count = np.bincount(flat[~np.repeat(held, size)], minlength=len(tags))
        cols = {"held": held.tobytes(), "round": np.array(rounds, np.uint8).tobytes(), "size": pack(size), "ids": _squeeze(flat), "tags": pack(tags, True), "count": pack(count)}
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "id": pa.array([list(ids)], pa.list_(at))} | {k: pa.array([v], pa.binary()) for k, v in cols.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        n, size, held, numbers, at = 0, 0, [], _Numbers(), None
        for b in pieces(batches):
            at = b.column(id_col).type
            for i, h, r, t in zip(b.column(id_col).to_pylist(), b.column("held").to_pylist(), b.column("round").to_pylist(), strings(b, text_col)):
                x = np.fromiter(map(numbers.__getitem__, [*t.encode().lower().split(), END]), np.int32)
                held.append((i, h, r, x))
                size += len(x)
                if size >= CHUNK_TOKENS:
                    yield flush(first + n, held, numbers, at)
                    n, size, held, numbers = n + 1, 0, [], _Numbers()
        if held:
            yield flush(first + n, held, numbers, at)

    out = f"chunk bigint, id array<{kind}>, held binary, round binary, size binary, ids binary, tags binary, count binary"
    own = docs.select(id_col, text_col, (crc_mod(F.col(id_col), 7) == 2).alias("held"), F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)).cast("int").alias("round"))
    return own.mapInArrow(run, out)


def slices(texts: DataFrame) -> DataFrame:
    """The training counts of the words of each chunk, a row for each slice of their hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            tags, count = unpack(b.column("tags")[0].as_py(), True), unpack(b.column("count")[0].as_py())
            cut = np.append(np.searchsorted(tags, np.arange(SLICES, dtype=np.uint64) * np.uint64(2**64 // SLICES)), len(tags))
            found = np.flatnonzero(np.diff(cut)).tolist()
            part = lambda x, ordered=False: pa.array([pack(x[cut[k] : cut[k + 1]], ordered) for k in found], pa.binary())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(b.column("chunk").to_pylist() * len(found), pa.int64()), "slice": pa.array(found, pa.int32()), "words": part(tags, True), "n": part(count)})

    return texts.select("chunk", "tags", "count").mapInArrow(run, "chunk bigint, slice int, words binary, n binary")


def _added(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key over the chunks' packed arrays, PART_CHUNKS at a time."""
    own, total = np.empty(0, np.uint64), np.empty(0, np.int64)
    for i in range(0, len(keys), PART_CHUNKS):
        x = np.concatenate([own, *(unpack(k, True) for k in keys[i : i + PART_CHUNKS])])
        n = np.concatenate([total, *(unpack(c).astype(np.int64) for c in counts[i : i + PART_CHUNKS])])
        order = np.argsort(x, kind="stable")
        x = x[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        own, total = x[first], np.add.reduceat(n[order], first) if len(x) else total
    return own, total


def corpus_counts(slices: DataFrame) -> DataFrame:
    """For each chunk and slice the corpus counts of its words, in the order of its arrays; and a row a slice (chunk null) with its words."""

    def add(t: pa.Table) -> pa.Table:
        raw = {c: t.column(c).to_pylist() for c in ("chunk", "words", "n")}
        words, n = _added(raw["words"], raw["n"])
        out = [(None, pack(words, True), pack(n))] + [(c, None, pack(n[np.searchsorted(words, unpack(w, True))])) for c, w in zip(raw["chunk"], raw["words"])]
        chunk, words_, n_ = zip(*out)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()] * len(out), pa.int32()), "chunk": pa.array(chunk, pa.int64()), "words": pa.array(words_, pa.binary()), "n": pa.array(n_, pa.binary())})

    return slices.groupBy("slice").applyInArrow(add, "slice int, chunk bigint, words binary, n binary")


# ---------------------------------------------------------------- classes and leaves


@dataclass
class Tree:
    """The nested classes: bands of counts, how many times each is halved, and its leaves' token totals."""

    step: int  # octaves of a band
    bits: np.ndarray  # halvings by class
    vocab: np.ndarray  # distinct words by class
    leaves: list[np.ndarray]  # by class: tokens of each leaf
    by_class: np.ndarray  # tokens by class
    tokens: int
    documents: int

    @property
    def classes(self) -> int:
        return len(self.bits)

    def class_of(self, tags: np.ndarray, n: np.ndarray) -> np.ndarray:
        """0: at most once; then bands; the last: the end token."""
        octave = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        c = np.where(n < 2, 0, np.minimum(1 + (octave - 1) // self.step, self.classes - 2))
        return np.where(tags == np.uint64(tag_of(END)), self.classes - 1, c)

    def class_share(self) -> np.ndarray:
        """Log shares of the classes, with places for what was never met."""
        known = self.by_class + np.eye(self.classes)[[0, -1]].sum(axis=0)
        return np.where(known > 0, np.log(np.maximum(known, 1e-9) / known.sum()), -NEVER).astype(np.float32)

    def leaf_of(self, c: int, tags: np.ndarray) -> np.ndarray:
        return (tags >> np.uint64(64 - int(self.bits[c]))).astype(np.int64) if self.bits[c] else np.zeros(len(tags), np.int64)

    def odds(self, cls: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """For each halving the log odds of the upper half at each word's node (NEVER, up or down, where a half has no words)."""
        out = [np.zeros(len(tags), np.float32) for _ in range(int(self.bits.max(initial=0)))]
        for c in range(1, self.classes - 1):
            at = np.flatnonzero(cls == c)
            leaf, below = self.leaf_of(c, tags[at]), self.leaves[c]
            for k in range(int(self.bits[c]) - 1, -1, -1):
                pair = below.reshape(-1, 2)
                odds = np.clip(np.log(np.maximum(pair[:, 1], 1e-30)) - np.log(np.maximum(pair[:, 0], 1e-30)), -NEVER, NEVER)
                leaf = leaf >> 1
                out[k][at], below = odds[leaf], pair.sum(axis=1)
        return out

    def log_share(self, tags: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log P(word | leaf): a share of the leaf's tokens; words met once and the place for unknown ones divide class 0."""
        once, out = float(self.vocab[0]), np.zeros(len(tags))
        out[cls == 0] = np.where(n[cls == 0] > 0, -math.log(2 * once + 1), math.log((once + 1) / (2 * once + 1)))
        for c in range(1, self.classes - 1):
            at = np.flatnonzero(cls == c)
            out[at] = np.log(n[at] / self.leaves[c][self.leaf_of(c, tags[at])])
        return out


def plant(counts: DataFrame) -> Tree:
    """Bands, digits and leaf totals from the corpus counts (rows of words a slice)."""

    def each(batches: Iterable[pa.RecordBatch], what) -> Iterator[tuple]:
        for b in pieces(batches, 1):
            words, n = unpack(b.column("words")[0].as_py(), True), unpack(b.column("n")[0].as_py()).astype(np.int64)
            yield from what(words, n)

    def octaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(66, np.int64)  # words by octave, then tokens, then end tokens

        def add(words: np.ndarray, n: np.ndarray) -> tuple:
            end = words == np.uint64(tag_of(END))
            total[64] += n.sum()
            total[65] += n[end].sum()
            n = n[(n > 0) & ~end]
            total[:64] += np.bincount(np.floor(np.log2(n)).astype(np.int64), minlength=64)
            return ()

        list(each(batches, add))
        yield pa.RecordBatch.from_pydict({"octave": pa.array(range(66), pa.int32()), "m": pa.array(total, pa.int64())})

    words = counts.where("chunk is null").select("words", "n")
    got = np.zeros(66, np.int64)
    for k, m in words.mapInArrow(octaves, "octave int, m bigint").groupBy("octave").agg(F.sum("m")).collect():
        got[k] = m
    by_octave, tokens, documents = got[:64], int(got[64]), int(got[65])
    top = int(np.flatnonzero(by_octave).max(initial=1))
    step = -(-top // BANDS)
    classes = 2 + -(-top // step)
    vocab = np.zeros(classes, np.int64)
    vocab[0] = by_octave[0]
    for o in range(1, top + 1):
        vocab[1 + (o - 1) // step] += by_octave[o]
    need = np.ceil(np.log2(np.maximum(vocab, 1)))
    bits = np.where(need <= 8, need, np.ceil(8 + (need - 8) / 3)).astype(int)
    bits[[0, -1]] = 0
    tree = Tree(step, bits, vocab, [np.zeros(1 << b) for b in bits], np.zeros(classes), tokens, documents)

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(words: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
            cls = tree.class_of(words, n)
            for c in range(1, classes - 1):
                at = np.flatnonzero(cls == c)
                if len(at):
                    leaf = tree.leaf_of(c, words[at])
                    low = leaf.min()
                    own = np.bincount(leaf - low, weights=n[at])
                    yield c, int(low), own.astype(np.float64).tobytes()

        rows = list(each(batches, add))
        yield pa.RecordBatch.from_pydict({"c": pa.array([r[0] for r in rows], pa.int32()), "low": pa.array([r[1] for r in rows], pa.int32()), "own": pa.array([r[2] for r in rows], pa.binary())})

    for c, low, own in words.mapInArrow(totals, "c int, low int, own binary").collect():  # in all about as many numbers as leaves
        x = np.frombuffer(own)
        tree.leaves[c][low : low + len(x)] += x
        tree.by_class[c] += x.sum()
    tree.by_class[[0, -1]] = vocab[0], documents
    return tree


# ---------------------------------------------------------------- features and softmaxes


class Chunk:
    """A chunk's texts, words and features; with ``number`` only the texts of that round and the words they have."""

    def __init__(self, row: dict, tree: Tree, rows: int, number: int | None = None):
        self.tree, self.rows = tree, rows
        self.tags, self.n = unpack(row["tags"], True), unpack(row["n"]).astype(np.int64)
        self.flat, self.size = _unsqueeze(row["ids"]), unpack(row["size"]).astype(np.int64)
        self.held, self.round = np.frombuffer(row["held"], bool), np.frombuffer(row["round"], np.uint8)
        if number is not None:
            ends, (low, high) = np.append(0, np.cumsum(self.size)), np.searchsorted(self.round, [number, number + 1])
            self.flat, self.size, self.held = self.flat[ends[low] : ends[high]], self.size[low:high], self.held[low:high]
            met = np.zeros(len(self.tags), bool)
            met[self.flat] = True
            self.flat, self.tags, self.n = (np.cumsum(met) - 1).astype(np.int32)[self.flat], self.tags[met], self.n[met]
        self.starts = np.cumsum(self.size) - self.size
        self.cls = tree.class_of(self.tags, self.n)
        self.bits, self.odds = tree.bits[self.cls].astype(np.int8), tree.odds(self.cls, self.tags)
        low, high = (self.tags & np.uint64(0xFFFFFFFF)).astype(np.uint32), (self.tags >> np.uint64(32)).astype(np.uint32)
        self.one, self.two = low * np.uint32(0x85EBCA6B) + np.uint32(1), (low ^ (low >> np.uint32(15))) * np.uint32(0xC2B2AE35) + np.uint32(2)
        self.nodes, self.upper = [], []
        for k in range(len(self.odds)):
            node = (high >> np.uint32(32 - k) if k else np.zeros_like(high)) * np.uint32(0x27D4EB2F) + ((self.cls.astype(np.uint32) << np.uint32(6)) + np.uint32(k)) * np.uint32(0x846CA68B)
            node = (node ^ (node >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            self.nodes.append(node ^ (node >> np.uint32(13)))
            self.upper.append((high >> np.uint32(31 - k)).astype(np.uint8) & 1)

    def part(self, low: int, high: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Word numbers and contexts of the tokens of the texts from ``low`` to ``high``."""
        starts = self.starts[low:high]
        a, b = (int(starts[0]), int(starts[-1] + self.size[high - 1])) if high > low else (0, 0)
        f, at = self.flat[a:b], starts - a
        one, two = np.zeros(len(f), np.uint32), np.zeros(len(f), np.uint32)
        one[1:], two[2:] = self.one[f[:-1]], self.two[f[:-2]]
        one[at], two[at] = 1, 2
        two[at[at + 1 < len(f)] + 1] = 2
        both = (one * np.uint32(31) + two) * np.uint32(0x165667B1)
        return f, [one, two, both ^ (both >> np.uint32(15))]

    def halves(self, f: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """By halving: the positions that have it, their weights' places by template, whether they are in the upper half, and its log odds.

        Positions come sorted by how many halvings they have, so each halving's are the first of the one before.
        """
        bits, shift = self.bits[f], np.uint32(33 - self.rows.bit_length())
        order = np.argsort(np.int8(127) - bits, kind="stable")  # by radix
        f, contexts = f[order], [c[order] for c in contexts]
        have = len(bits) - np.cumsum(np.bincount(bits, minlength=len(self.nodes) + 1))
        for k, n in enumerate(have[: len(self.nodes)].tolist()):
            if not n:
                return
            own = f[:n]
            node = self.nodes[k].take(own)
            yield order[:n], [(c[:n] ^ node) * _ODD >> shift for c in contexts], self.upper[k].take(own), self.odds[k].take(own)


def class_rows(contexts: list[np.ndarray], rows: int) -> list[np.ndarray]:
    shift = np.uint32(33 - (rows // CLASS_SHARE).bit_length())
    return [c * _ODD >> shift for c in contexts]


def log_softmax(share: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Log probabilities of the classes for a batch of positions: shares and a sum of weight rows, normalised."""
    z = weights[0].take(rows[0], axis=0)
    for w, r in zip(weights[1:], rows[1:]):
        z += w.take(r, axis=0)
    z += share
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _batches(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def _squeeze_block(seen: np.ndarray, hoped: np.ndarray) -> bytes:
    """Whole counts, and the three high bytes of each expected one, as planes of bytes."""
    rounded = (hoped.astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)
    both = np.concatenate([seen.astype(np.uint32), rounded])
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze_block(data: bytes) -> np.ndarray:
    """(2, BLOCK): observed and expected counts."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * BLOCK, codec="zstd", asbytes=True), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return np.stack([both[:BLOCK].astype(np.float64), (both[BLOCK:] << np.uint32(8)).view(np.float32).astype(np.float64)])


def chunk_sums(x: Chunk, weights: list[np.ndarray], total: list[np.ndarray]) -> None:
    """Adds a chunk's sums over its training documents to ``total``: by table of weights, two rows.

    Of classes: observed and expected counts. Of halves: how often the node was met with the feature, and the
    upper half's observed less expected counts.
    """
    f, contexts = x.part(0, len(x.size))
    train = ~np.repeat(x.held, x.size)
    f, contexts = f[train], [c[train] for c in contexts]
    share, cls, width = x.tree.class_share(), x.cls[f], x.tree.classes
    rows, height = class_rows(contexts, x.rows), weights[0].shape[1]
    own = [t[:, : w.size].reshape(2, TEMPLATES, -1) for t, w in zip(total, weights)]  # views
    for t, r in enumerate(rows):
        own[0][0, t] += np.bincount(r.astype(np.int64) * width + cls, minlength=height * width)
    for part in _batches(len(f), BATCH):
        p = np.empty((part.stop - part.start, width))
        for q in _batches(len(p), CLASS_BATCH):
            p[q] = np.exp(log_softmax(share, weights[0], [r[part][q] for r in rows]))
        for t, r in enumerate(rows):
            at = (r[part].astype(np.int64) * width)[:, None] + np.arange(width)
            own[0][1, t] += np.bincount(at.ravel(), p.ravel(), height * width)
        places, left = [], []
        for _, features, up, z in x.halves(f[part], [c[part] for c in contexts]):
            for w, r in zip(weights[1], features):
                z += w.take(r)
            places.append(features)
            left.append(up - 1 / (1 + np.exp(-z)))
        if places:
            rest = np.concatenate(left).astype(np.float64)
            for t, features in enumerate(zip(*places)):
                at = np.concatenate(features).astype(np.int64)
                own[1][0, t] += np.bincount(at, minlength=x.rows)
                own[1][1, t] += np.bincount(at, rest, x.rows)


def feature_sums(ready: DataFrame, tree: Tree, weights: list[np.ndarray], number: int) -> list[np.ndarray]:
    """``chunk_sums`` of the whole corpus, for each table of weights (2, *its shape).

    As many tasks as run at once each send their blocks, so what is shuffled does not grow with the chunks;
    chunks reach Python one at a time, so memory does not either.
    """
    shapes, rows = [w.shape for w in weights], weights[1].shape[1]
    length = [-(-w.size // BLOCK) * BLOCK for w in weights]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, n)) for n in length]
        for b in pieces(batches, 1):
            chunk_sums(Chunk(b.to_pylist()[0], tree, rows, number), weights, total)
        for k, t in enumerate(total):
            for b in range(0, length[k], BLOCK):
                if t[0, b : b + BLOCK].any() or t[1, b : b + BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "block": pa.array([b], pa.int32()), "data": pa.array([_squeeze_block(*t[:, b : b + BLOCK])], pa.binary())})

    def whole(t: pa.Table) -> pa.Table:
        both = np.sum([_unsqueeze_block(x) for x in sorted(t.column("data").to_pylist())], axis=0)
        return pa.table({"k": t.column("k")[:1], "block": t.column("block")[:1], "data": pa.array([both.astype(np.float32).tobytes()], pa.binary())})

    out = [np.zeros((2, n), np.float32) for n in length]
    tasks, kind = ready.sparkSession.sparkContext.defaultParallelism, "k int, block int, data binary"
    conf, rows_at_once = ready.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows_at_once)
    conf.set(rows_at_once, "1")
    try:
        own = ready.drop("id").coalesce(tasks).mapInArrow(add, kind)
        for k, b, data in own.groupBy("k", "block").applyInArrow(whole, kind).toLocalIterator():
            out[k][:, b : b + BLOCK] = np.frombuffer(data, np.float32).reshape(2, BLOCK)
    finally:
        conf.set(rows_at_once, before)
    return [x[:, : math.prod(s)].reshape(2, *s) for x, s in zip(out, shapes)]


def updated(weights: list[np.ndarray], sums: list[np.ndarray], bounds: list[np.ndarray]) -> list[np.ndarray]:
    """A step along the gradient, over the mean of this round's curvature bound and all rounds' (``bounds``, which grow in place)."""
    (seen, hoped), (met, up) = sums
    out = []
    for w, down, own, bound, damp in zip(weights, (seen - hoped, up), (0.5 * (seen + hoped), met / 4), bounds, DAMP):
        bound += own
        out.append(w + np.float32(RATE) * down / (np.sqrt(own * bound) + np.float32(damp)))
    return out


def train(ready: DataFrame, tree: Tree) -> list[np.ndarray]:
    """Weights of the classes and of the halves after ROUNDS updates."""
    rows = rows_for(tree.tokens)
    weights = [np.zeros((TEMPLATES, rows // CLASS_SHARE, tree.classes), np.float32), np.zeros((TEMPLATES, rows), np.float32)]
    bounds = [np.zeros_like(w) for w in weights]
    for number in range(ROUNDS if tree.tokens else 0):
        weights = updated(weights, feature_sums(ready, tree, weights, number), bounds)
    return weights


def logs(x: Chunk, weights: list[np.ndarray], f: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """log P(word | history) of positions of a chunk."""
    out = x.tree.log_share(x.tags, x.n, x.cls)[f]
    share, rows, cls = x.tree.class_share(), class_rows(contexts, x.rows), x.cls[f]
    for part in _batches(len(f), CLASS_BATCH):
        z = log_softmax(share, weights[0], [r[part] for r in rows])
        out[part] += z[np.arange(len(z)), cls[part]]
    for part in _batches(len(f), BATCH):
        first, total = None, np.zeros(part.stop - part.start)
        for at, features, up, z in x.halves(f[part], [c[part] for c in contexts]):
            for w, r in zip(weights[1], features):
                z += w.take(r)
            z[up == 1] *= -1
            total[: len(at)] -= np.log1p(np.exp(np.minimum(z, 80)))
            first = at if first is None else first
        if first is not None:
            out[part][first] += total[: len(first)]
    return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = scratch.save(chunks(docs, id_col=id_col, text_col=text_col))
    counts = scratch.save(corpus_counts(slices(texts)))
    tree = plant(counts)

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.concatenate([unpack(x.as_py()) for x in right.sort_by("slice").column("n")])
        return left.drop(["count"]).append_column("n", pa.array([pack(n)], pa.binary()))

    kept = [f for f in texts.schema.fields if f.name != "count"]
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    ready = scratch.save(texts.groupBy("chunk").cogroup(counts.where("chunk is not null").groupBy("chunk")).applyInArrow(give, f"{own}, n binary"))
    scratch.drop(texts)
    vocab = int(tree.vocab.sum()) + (tree.documents > 0)
    log_base = math.log10(tree.tokens + vocab + 1)
    scratch.drop(counts)
    weights = train(ready, tree)
    out = f"{id_col} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            x = Chunk(b.drop_columns(["id"]).to_pylist()[0], tree, weights[1].shape[1])
            got = np.zeros((3, len(x.size)))  # known tokens, base and score
            known, base = (x.n > 0).astype(np.int64), np.log10(x.n + 1.0)
            cut = np.flatnonzero(np.diff(x.starts // PART_TOKENS, prepend=-1)).tolist() + [len(x.size)]
            for low, high in zip(cut, cut[1:]):
                f, contexts = x.part(low, high)
                at = x.starts[low:high] - x.starts[low]
                got[:, low:high] = [np.add.reduceat(v, at) for v in (known[f], base[f], logs(x, weights, f, contexts))]
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: b.column("id").flatten(),
                    "held_out": pa.array(x.held),
                    "n_tokens": pa.array(x.size, pa.int64()),
                    "n_known": pa.array(got[0].astype(np.int64)),
                    "train_tokens": pa.array([tree.tokens] * len(x.size), pa.int64()),
                    "base_score": got[1] - x.size * log_base,
                    "score": got[2] / math.log(10),
                }
            )

    return ready.mapInArrow(run, out)
