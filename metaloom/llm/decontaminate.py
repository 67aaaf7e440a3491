"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (lower case, letters and digits only). A random walk (CGK) maps a window of
words to a string of fixed length: at step j it writes the word under the cursor, and a hash bit of (j,
word) says whether the cursor moves on; windows at small edit distance become strings at small Hamming
distance. ``REPS`` samples of ``SAMPLED`` coordinates each are the LSH keys; every ``PER_WALK`` of them have
a walk with hash bits of its own, so that an edit after which one walk diverges does not make all of them
miss together. Every benchmark item is cut into blocks of ``BLOCK`` words, every ``STRIDE`` words (items of
fewer than ``SHORT`` words at every word); every window of that size in a document (by a
count that an edit distance within the bound implies, only those with enough benchmark words) is looked
up, and each hit is verified by the exact edit distance of the whole item against its place in the
document. An item is found where at most ``1 - similarity`` of its words are edited.

Keys and walks find at least ``TARGET`` of the items that have all the edits allowed, at every length (tested
on their own). They miss some places near that bound, so the items' pieces are looked up too: an item that may
have e edits is cut into e + 1 pieces, of which one at least is left as it was. Every place within the
bound is thus a candidate: the recall is 1, whatever the walk does (but for equal hashes, which only add
candidates).

Edge cases: null or empty texts and items match nothing; items shorter than BLOCK words are a block of
their own, and those of fewer than five words need an exact match; rows that repeat an id count as they
are; the benchmark is taken in pieces of ``ITEMS_AT_ONCE``, so what is sent to the tasks is bounded;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, pieces, strings

BLOCK, STRIDE, REPS, PER_WALK, SAMPLED, SIMILARITY, ITEMS_AT_ONCE = 12, 3, 40, 5, 6, 0.8, 20_000
TARGET = 0.95
SHORT = 24  # words below which an item has a block at every word
MEMO_WORDS = 300_000
_JUNK = re.compile(r"[\W_]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := _JUNK.sub("", x))]


def edits_allowed(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9) if n >= 5 else 0


def edit_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """The least word edit distance of the item to any stretch of the region: (distance, start, end), the leftmost shortest of equals."""
    m = len(region)
    row = [(0, -j) for j in range(m + 1)]  # distance, then the later start
    item, region = item.tolist(), region.tolist()
    for i, w in enumerate(item, 1):
        new = [(i, 0)]
        for j in range(1, m + 1):
            a, b = row[j - 1]
            best = (a + (w != region[j - 1]), b)
            up = row[j]
            if (up[0] + 1, up[1]) < best:
                best = (up[0] + 1, up[1])
            lf = new[j - 1]
            if (lf[0] + 1, lf[1]) < best:
                best = (lf[0] + 1, lf[1])
            new.append(best)
        row = new
    d, end = min((row[j][0], j) for j in range(m + 1))
    return d, -row[end][1], end


def least_edits(item: dict[int, int], size: int, region: list[int]) -> int:
    """The least word edit distance of an item to any stretch of the region, by Myers' bit vectors; the item is given as word to positions."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    up, down, now = full, 0, size
    best = size
    for w in region:
        eq = item.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & high:
            now += 1
        elif mh & high:
            now -= 1
            best = min(best, now)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (~(xv | ph) & full), ph & xv
    return best


class Index:
    """LSH tables of the benchmark's blocks; small, built on the driver and sent to the tasks."""

    def __init__(self, items: list[tuple[object, str]], similarity: float = SIMILARITY, reps: int = REPS):
        self.similarity = similarity
        self.items = [(k, w) for k, t in items if (w := words_of(t or ""))]
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        rng = np.random.default_rng(7)
        self.bits = rng.integers(0, 2**63, (-(-reps // PER_WALK), len(self.vocab) + 1), dtype=np.uint64)  # 2 * BLOCK of them are used
        self.mix = rng.integers(1, 2**62, 2 * BLOCK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.ids = [np.array([self.vocab[w] for w in ws], np.int32) for _, ws in self.items]
        self.positions: dict[int, dict[int, int]] = {}
        self.reps, blocks = reps, defaultdict(list)
        for n, ids in enumerate(self.ids):
            size, stride = min(BLOCK, len(ids)), 1 if len(ids) < SHORT else STRIDE
            for at in {*range(0, len(ids) - size + 1, stride), len(ids) - size}:
                blocks[size].append((n, at, ids[at : at + size]))
        self.tables = {}
        for size, found in sorted(blocks.items()):
            words, starts = np.concatenate([np.append(b, np.zeros(size, np.int32)) for _, _, b in found]), np.arange(len(found)) * 2 * size
            where = np.array([(n, at) for n, at, _ in found], np.int32)
            table = []
            for sig in self.signatures(words, starts, size):
                order = np.argsort(sig, kind="stable")
                low = np.zeros(1 << 18, bool)
                low[(sig >> np.uint64(46)).astype(np.int64)] = True
                table.append((sig[order], where[order], low))
            self.tables[size] = table
        seeds = defaultdict(list)
        for n, ids in enumerate(self.ids):
            parts = min(edits_allowed(len(ids), similarity) + 1, len(ids))
            size = min(BLOCK, len(ids) // parts)
            seeds[size] += [(ids[at : at + size], n, at) for at in range(0, parts * (len(ids) // parts), len(ids) // parts)]
        self.seeds = {}
        for size, found in sorted(seeds.items()):
            sig = self.exact(np.concatenate([w for w, _, _ in found]), np.arange(len(found)) * size, size)
            order = np.argsort(sig, kind="stable")
            low = np.zeros(1 << 18, bool)
            low[(sig >> np.uint64(46)).astype(np.int64)] = True
            self.seeds[size] = (sig[order], np.array([(n, at) for _, n, at in found], np.int32)[order], low)

    def exact(self, x: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash keys of whole windows."""
        sig = np.zeros(len(starts), np.uint64)
        for j in range(size):
            sig = (sig ^ x[starts + j].astype(np.uint64)) * self.mix[j]
            sig ^= sig >> np.uint64(29)
        return sig * self.mix[0]

    def embed(self, x: np.ndarray, starts: np.ndarray, size: int, walk: int) -> np.ndarray:
        """A walk's output, one column per window; past its end a window has zeros."""
        at, stop, bits = starts.astype(np.int64), starts + size, self.bits[walk]
        out = np.zeros((2 * size, len(starts)), np.int32)
        for j in range(2 * size):
            w = np.where(at < stop, x[np.minimum(at, len(x) - 1)], 0)
            out[j] = w
            at += ((bits[w] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        return out

    def signatures(self, x: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Hash keys of the sampled coordinates, one array per repetition; every ``PER_WALK`` repetitions have a walk of their own."""
        rng = np.random.default_rng(size)
        for r in range(self.reps):
            if r % PER_WALK == 0:
                walked = self.embed(x, starts, size, r // PER_WALK)
            sig = np.zeros(len(starts), np.uint64)
            for c in rng.choice(2 * size, min(SAMPLED, 2 * size), replace=False):
                sig = (sig ^ walked[c].astype(np.uint64)) * self.mix[c]
                sig ^= sig >> np.uint64(29)
            yield sig * self.mix[0]

    def has(self, n: int, region: np.ndarray, slack: int) -> bool:
        """Whether an item has a stretch of the region within the bound."""
        if n not in self.positions:
            own: dict[int, int] = defaultdict(int)
            for i, w in enumerate(self.ids[n].tolist()):
                own[w] |= 1 << i
            self.positions[n] = dict(own)
        return least_edits(self.positions[n], len(self.ids[n]), region.tolist()) <= slack

    def places(self, x: np.ndarray) -> dict[int, set[int]]:
        """Item number to the starts at which its whole window may lie, for words x (0: no benchmark word) that end in zeros."""
        known = np.concatenate([[0], np.cumsum(x > 0)])
        found: dict[int, set[int]] = defaultdict(set)
        for size, table in self.tables.items():
            if len(x) < size:
                continue
            need = size - edits_allowed(size, self.similarity)
            starts = np.flatnonzero(known[size:] - known[:-size] >= need)
            if not len(starts):
                continue
            for (sigs, where, low), sig in zip(table, self.signatures(x, starts, size)):
                maybe = np.flatnonzero(low[(sig >> np.uint64(46)).astype(np.int64)])
                a, b = np.searchsorted(sigs, sig[maybe], "left"), np.searchsorted(sigs, sig[maybe], "right")
                for i in np.flatnonzero(b > a):
                    for n, at in where[a[i] : b[i]].tolist():
                        found[n].add(int(starts[maybe[i]]) - at)
        return found


    def intact(self, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, place of one of its pieces, start at which the whole item may lie), for words x as in ``places``."""
        known = np.concatenate([[0], np.cumsum(x > 0)])
        for size, (sigs, where, low) in self.seeds.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            sig = self.exact(x, starts, size)
            maybe = np.flatnonzero(low[(sig >> np.uint64(46)).astype(np.int64)])
            a, b = np.searchsorted(sigs, sig[maybe], "left"), np.searchsorted(sigs, sig[maybe], "right")
            for i in np.flatnonzero(b > a):
                place = int(starts[maybe[i]])
                for n, at in where[a[i] : b[i]].tolist():
                    yield n, place, place - at


class _Words(dict):
    """Raw word to vocabulary number: 0 for other words, -1 for what has no letter or digit."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        w = raw.lower()
        n = self.vocab.get(w)
        if n is None:
            w = w.strip(_MARKS)
            if not w.isalnum():
                w = _JUNK.sub("", w)
            n = self.vocab.get(w, 0) if w else -1
        self[raw] = n
        return n


def _numbers(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as numbers with BLOCK zeros after each text, and the texts' starts."""
    parts, starts, at, gap = [], [], 0, np.zeros(BLOCK, np.int32)
    for t in texts:
        x = np.fromiter(map(words.__getitem__, t.split()), np.int32)
        x = x[x >= 0]
        starts.append(at)
        parts += [x, gap]
        at += len(x) + BLOCK
    return np.concatenate(parts) if parts else gap, np.array(starts, np.int64)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, similarity: float) -> Iterator[Index]:
    """Indexes of pieces of the benchmark, each of a bounded number of items."""
    n = benchmark.count()
    parts = -(-n // ITEMS_AT_ONCE)
    for i in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64(F.col(item_col), F.col(text_col)), F.lit(parts)) == i).select(item_col, text_col)
        yield Index([(r[0], r[1]) for r in part.collect()], similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, item_words): the best place of every benchmark item in every document that has it.

    Ids of both tables may be of any type; where both columns have one name, the item's is returned as item_<name>.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    names = [id_col, item_col if item_col != id_col else f"item_{item_col}", "start_word", "end_word", "edits", "item_words"]
    out = ", ".join(f"`{n}` {k}" for n, k in zip(names, (kind, item_kind, "int", "int", "int", "int")))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def search(index: Index) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _Words(index.vocab)
            for b in pieces(batches):
                x, starts = _numbers(strings(b, text_col), words)
                rows, ids = [], b.column(id_col).to_pylist()
                ends = np.append(starts[1:], len(x))
                for i, found in _by_text(index, x, starts, ends):
                    rows += [(ids[i], index.items[n][0], s, e, d, len(index.ids[n])) for n, s, e, d in found]
                cols = list(zip(*rows)) or [[]] * 6
                types = [b.column(id_col).type, item_type, *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        return docs.select(id_col, text_col).mapInArrow(run, out)

    scratch, found = Scratch(docs.sparkSession), []
    for index in _indexes(benchmark, item_col, item_text_col, similarity):  # one index at a time is held and sent
        if found:
            found[-1] = found[-1] if hasattr(found[-1], "_scratch_path") else scratch.save(found[-1])
        found.append(search(index) if not found else scratch.save(search(index)))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], out)


def _by_text(index: Index, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list]]:
    """Candidates are looked up over all texts at once and verified text by text; windows do not reach over a text's zeros by the count they need."""
    places = defaultdict(lambda: defaultdict(set))
    for n, at in index.places(x).items():
        for s in at:
            i = int(np.searchsorted(starts, max(s, 0), "right")) - 1
            for k in {i, min(i + 1, len(starts) - 1)}:  # an item that starts before its text does
                if s < ends[k] and s + len(index.ids[n]) > starts[k]:
                    places[k][n].add(s - int(starts[k]))
    for n, place, s in index.intact(x):
        k = int(np.searchsorted(starts, place, "right")) - 1
        places[k][n].add(s - int(starts[k]))
    for i in sorted(places):
        own = x[starts[i] : ends[i] - BLOCK]
        found = []
        for n, at in sorted(places[i].items()):
            item, best, done = index.ids[n], None, None
            slack = edits_allowed(len(item), index.similarity)
            for s in sorted(at):
                if done is not None and s <= done:
                    continue
                done = s + slack
                low, high = max(0, s - slack), min(len(own), s + len(item) + 2 * slack)
                if high <= low or not index.has(n, own[low:high], slack):
                    continue
                d, a, b = edit_place(item, own[low:high])
                if best is None or d < best[2]:
                    best = (low + a, low + b, d)
            if best:
                found.append((n, *best))
        if found:
            yield i, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that contain no benchmark item, all columns kept; the texts are decided where they lie, without a shuffle."""
    for index in _indexes(benchmark, item_col, item_text_col, similarity):

        def run(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            words = _Words(index.vocab)
            for b in pieces(batches):
                x, starts = _numbers(strings(b, text_col), words)
                hit = {i for i, _ in _by_text(index, x, starts, np.append(starts[1:], len(x)))}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
