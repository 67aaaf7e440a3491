"""Byte-level BPE encoding and decoding by a published rank file.

Method: a text is cut into words by the vocabulary's pattern; ranked merges are folded over the byte
array of each *distinct* word, and a text's ids are its words' ids in order; decoding concatenates the
binary pieces of the ids.

``encode``/``decode`` keep the fold of distinct words in Arrow batches: a worker folds a word once and
then finds it in a table that is emptied when it reaches ``memo_words`` entries (a cache only: nothing is
dropped).  ``encode_words_native`` is the same fold as Spark higher-order functions over a literal rank
map; the README gives the figures that keep it off the main path.

Edge cases: a null or empty text has no ids; invalid ids raise KeyError in ``decode``; other columns of
the input are ignored unless named in ``keep``; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, strings

MEMO_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair of lowest rank is joined until no pair has a rank; of equal ranks the leftmost."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _fold_long(parts, ranks)
    got = ranks.get
    pairs = [got(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = got(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = got(parts[at] + parts[at + 1])


def _fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and linked neighbours: n log n for words of any length."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = a + b, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] >= 0 and (r := ranks.get(parts[k] + parts[right[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class _Table(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; a missing word is folded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = array("I", fold_merges(word.encode(), self.ranks)).tobytes()
        self[word] = ids
        return ids


_WORKER: dict[tuple[str, str], tuple] = {}


def _tools(path: str, pattern: str) -> tuple:
    """Kept by a worker between tasks: find-all, the fold's table, the pieces by id."""
    if (path, pattern) not in _WORKER:
        ranks = load_ranks(path)
        _WORKER[path, pattern] = (regex.compile(pattern).findall, _Table(ranks), {i: b for b, i in ranks.items()})
    return _WORKER[path, pattern]


def encode_text(text: str, path: str, pattern: str, memo_words: int = MEMO_WORDS) -> bytes:
    find, words, _ = _tools(path, pattern)
    if len(words) > memo_words:
        words.clear()
    return b"".join(map(words.__getitem__, find(text)))


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    return b"".join(map(_tools(path, pattern)[2].__getitem__, memoryview(ids).cast("I")))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Ids of every text: id, n_tokens, ids array<int> (``with_ids``), and with ``digests`` the SHA-256 of ids and of the decoded bytes."""
    kind = docs.schema[id_col].dataType
    out = f"{id_col} {kind.simpleString()}, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = [encode_text(t, path, pattern) for t in strings(b, text_col)]
            cols = {id_col: b.column(id_col), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if with_ids:
                ends = pa.array([0, *_running(len(x) // 4 for x in ids)], pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))]))
            if digests:
                cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                cols["decoded_sha256"] = pa.array([hashlib.sha256(decode_ids(x, path, pattern)).hexdigest() for x in ids])
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def _running(counts: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def decode(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that each ids array stands for: id, decoded binary (null ids: empty)."""
    kind = encoded.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data = [decode_ids(array("I", x or []).tobytes(), path, pattern) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: b.column(id_col), "decoded": pa.array(data, pa.binary())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, decoded binary")


BUCKETS = 1 << 16


def rank_buckets(ranks: dict[bytes, int]) -> str:
    """The rank map as text: line i has ";hex:rank" of the pieces whose hash falls into bucket i, so a lookup reads about one entry."""
    lines = [""] * BUCKETS
    for piece, r in ranks.items():
        lines[xxhash.xxh64_intdigest(piece.hex().encode(), 42) % BUCKETS] += f";{piece.hex()}:{r}"
    return "\n".join(lines)


def encode_words_native(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """The fold as Spark higher-order functions over a literal rank map: ``word`` and ``ids``.

    A word is an array of hexadecimal pieces. Each step looks up all adjacent pairs, joins the one of least
    rank and goes on until none has a rank. The literal is split once, when the plan is optimised.
    """
    buckets = F.split(F.lit(rank_buckets(load_ranks(path))), "\n")

    def rank(piece: Column) -> Column:
        line = F.get(buckets, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int"))
        key = F.concat(F.lit(";"), piece, F.lit(":"))
        return F.when(F.contains(line, key), F.split_part(F.split_part(line, key, F.lit(2)), F.lit(";"), F.lit(1)).cast("int"))

    hexed = F.lower(F.hex(F.encode(F.col(word_col), "UTF-8")))
    units = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))
    start = F.when(F.length(hexed) > 0, units).otherwise(F.array().cast("array<string>"))
    none = 2**31 - 1

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(none)).alias("r"), i.alias("i")))
        merged = lambda best: F.when(best["r"] == none, parts).otherwise(F.concat(F.slice(parts, F.lit(1), best["i"]), F.array(F.concat(F.get(parts, best["i"]), F.get(parts, best["i"] + 1))), F.slice(parts, best["i"] + 3, F.size(parts))))
        return F.when(F.size(parts) < 2, parts).otherwise(F.transform(F.array(F.array_min(pairs)), merged)[0])

    merged = F.aggregate(start, start, step)
    return words.select(F.col(word_col).alias("word"), F.transform(merged, rank).alias("ids"))
