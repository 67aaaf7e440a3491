"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. A word that looks written around a filter (digits or
symbols for letters, letters repeated, characters or spaces put between letters) becomes a lattice of
readings, and Viterbi decoding under the character model and the channel's costs restores the likeliest
one; other words are their own reading. A logistic model over restored words, fitted on a labelled sample
(at most ``SAMPLE_ROWS`` rows, the only bound), scores the text. Its lexicon holds the words of at least
``MIN_DOCS`` toxic documents found at a false discovery rate of ``FALSE_SHARE``.

Edge cases: null and empty texts score as texts without words; null labels are left out, of labels that
repeat an id the largest counts; without labels of both classes the score is the smoothed share of label
1; rows that repeat an id are rows of their own; words and texts of any length are decoded whole; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, strings
from .quality import labelled_sample

SAMPLE_ROWS, MIN_DOCS, FALSE_SHARE, THRESHOLD = 20_000, 3, 0.001, 0.5
MEMO_WORDS = 300_000

# The letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
COST = {"leet": 1.0, "drop": 2.0, "drop_leet": 4.0, "drop_digit": 9.0, "gap": 5.0, "repeat": 0.4, "literal_digit": 4.0}

LM_WEIGHT = 0.4  # of the character model against the channel
SIZE = 64  # of the character model's alphabet: 0 is a gap, 1 any other character
_CODES = np.ones(0x110000, np.uint8)
for _c in " \t\n\v\f\r":
    _CODES[ord(_c)] = 0
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))), 2):
    _CODES[ord(_c)] = _i
_CODE = {chr(i): int(_CODES[i]) for i in range(0x100)}
_RUN = re.compile(r"(.)\1\1+", re.S)
_LEFT = "\"#%&'()*,-./:;<=>?[\\]^_`{}~¡¿«»…“”‘’–—"
_EDGE = "!\"#%&'()*,-./:;<=>?[\\]^_`{|}~¡¿«»…“”‘’–—"


def count_characters(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts: each task sends its non-zero cells, at most SIZE**3 of them exist."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in pieces(batches):
            x = _CODES[np.frombuffer((" " + "  ".join(strings(b, text_col)).lower() + " ").encode("utf-32-le"), np.uint32)].astype(np.int32)
            total += np.bincount(x[:-2] * SIZE**2 + x[1:-1] * SIZE + x[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and a uniform share."""
    two = counts.sum(axis=0)
    p2 = (two + 0.1) / (two + 0.1).sum(axis=1, keepdims=True)
    return np.log((counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """The readings of each run of a lower-case word: (letters, cost)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        n, i = j - i, j
        letters = c if c.isalpha() else LEET.get(c, "")
        base = 0.0 if c.isalpha() else COST["leet"]
        ways = [(x * k, base * k + COST["repeat"] * (n != k)) for x in letters for k in ({n} if n < 3 else {1, 2})]
        if not c.isalpha():
            ways.append(("", COST["drop_digit" if c.isdigit() else "drop_leet" if letters else "drop"] * n))
            ways += [(" ", COST["gap"] * n)] if not c.isdigit() else [(c * n, COST["literal_digit"] * n)]
        out.append(ways)
    return out


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case word by Viterbi decoding over the last two characters."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def step(states: dict, text: str, cost: float, into: dict) -> None:
        for (a, b), (s, path) in states.items():
            s -= cost
            for c in text:
                k = _CODE.get(c, 1)
                s += LM_WEIGHT * float(model[a, b, k])
                a, b, path = b, k, (path, c)
            if (a, b) not in into or into[a, b][0] < s:
                into[a, b] = (s, path)

    for ways in lattice(word):
        new: dict = {}
        for text, cost in ways:
            step(states, text, cost, new)
        states = new
    last: dict = {}
    step(states, " ", 0.0, last)
    _, path = max(last.values(), key=lambda x: x[0])
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


class Reader(dict):
    """Raw word to its restored words; plain words are themselves in lower case without marks around them."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > MEMO_WORDS:
            self.clear()
        out = self[raw] = self.read(raw)
        return out

    def read(self, raw: str) -> tuple[str, ...]:
        w = raw.lower().rstrip(_EDGE).lstrip(_LEFT)
        for mark in "$@+!|":
            if w.endswith(mark * 3) or w.startswith(mark * 3):
                w = w.strip(mark + _EDGE)
        if w.isalpha() and not _RUN.search(w):
            return (w,)
        if not any(c.isalpha() or c in LEET for c in w) or w.isdigit():
            return ()
        return tuple(restore(w, self.model).split())

    def words(self, text: str) -> Iterator[tuple[str, ...]]:
        """The restored words of a text; single letters in a row of three or more are read as one word."""
        raw = text.split()
        short = bytes(map(min, map(len, raw), repeat(2)))
        at = short.find(b"\1\1\1")
        if at >= 0:
            joined, done = [], 0
            while at >= 0:
                end = at
                while end < len(raw) and short[end] == 1:
                    end += 1
                joined += [*raw[done:at], "".join(raw[at:end])]
                done, at = end, short.find(b"\1\1\1", end)
            raw = joined + raw[done:]
        return map(self.__getitem__, raw)

    def text(self, text: str) -> str:
        return " ".join(x for w in self.words(text) for x in w)


@dataclass
class Model:
    characters: np.ndarray
    lexicon: dict[str, int]
    weights: np.ndarray  # intercept, group features, then a weight for each word of the lexicon

    def score(self, hits: Counter) -> float:
        z = group_features(np.array([sum(hits.values())]))[0] @ self.weights[:GROUP] + sum(float(self.weights[GROUP + k]) * math.log1p(c) for k, c in hits.items())
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, float(z)))))


GROUP = 5


def group_features(n: np.ndarray) -> np.ndarray:
    """One, steps of how many words of the lexicon a text has, and the log of it."""
    return np.column_stack([np.ones(len(n)), n >= 1, n >= 2, n >= 3, np.log1p(n)]).astype(float)


def fit_logistic(group: np.ndarray, at: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, y: np.ndarray, ridge: float = 1.0, steps: int = 3000) -> np.ndarray:
    """Ridge-penalised logistic regression over dense ``group`` columns and sparse others (row ``at``, ``col``, ``value``).

    Accelerated gradient steps with restarts; the intercept, the first group column, is hardly penalised.
    """
    g = group.shape[1]
    penalty = np.r_[1e-3, np.full(g + width - 1, ridge)]
    times = lambda w: group @ w[:g] + np.bincount(at, weights=value * w[g:][col], minlength=len(y))
    back = lambda r: np.r_[group.T @ r, np.bincount(col, weights=value * r[at], minlength=width)]
    v = np.ones(g + width)
    for _ in range(30):
        v = back(times(v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * 1.05 * (v @ back(times(v))) + ridge)
    w = look = np.zeros(g + width)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(look), -40, 40)))
        down = back(p - y) + penalty * look
        new = look - rate * down
        if down @ (new - w) > 0:
            t = 1.0
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, w, t, moved = new + (t - 1) / nt * (new - w), new, nt, np.abs(new - w).max()
        if moved < 1e-6:
            break
    return w


def discoveries(a: np.ndarray, b: np.ndarray, share: float, false_share: float = FALSE_SHARE) -> np.ndarray:
    """Which words, in ``a`` toxic and ``b`` clean documents, are toxic more often than the share of toxic documents tells.

    By the signed root of the binomial deviance, of which rare words that separate the classes get their due;
    the cut keeps the expected share of false ones among those found (Benjamini and Hochberg).
    """
    n = a + b
    deviance = 2 * (a * np.log(np.maximum(a, 1) / (n * share)) + b * np.log(np.maximum(b, 1) / (n * (1 - share))))
    z = np.where(a > n * share, np.sqrt(np.maximum(deviance, 0)), 0.0)
    p = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in z])
    ranked = np.sort(p)
    under = np.flatnonzero(ranked <= false_share * np.arange(1, len(p) + 1) / max(1, len(p)))
    return p <= (ranked[under[-1]] if len(under) else -1.0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", scratch: Scratch | None = None) -> Model:
    scratch = scratch or Scratch(docs.sparkSession)
    characters = character_model(count_characters(docs, text_col=text_col))
    sample = labelled_sample(labels, label_col, id_col, SAMPLE_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(characters)
        for b in pieces(batches):
            found = [Counter(x for w in read.words(t) for x in w) for t in strings(b, text_col)]
            yield pa.RecordBatch.from_pydict({id_col: b.column(id_col), "y": b.column("y"), "words": pa.array([[{"w": k, "n": n} for k, n in c.items()] for c in found], pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())])))})

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # at most SAMPLE_ROWS rows
    rows = scratch.save(own.mapInArrow(run, f"{id_col} {kind}, y double, words array<struct<w string, n int>>").withColumn("row", F.monotonically_increasing_id()))
    n1, n0 = (rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0)))).first()
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(characters, {}, np.array([np.log(share / (1 - share))] + [0.0] * (GROUP - 1)))
    each = rows.select("row", "y", F.explode("words").alias("x")).select("row", "y", "x.w", "x.n")
    odds = each.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= MIN_DOCS).orderBy("w").toArrow()
    found = odds.select(["w"]).filter(pa.array(discoveries(odds.column("a").to_numpy(), odds.column("b").to_numpy(), n1 / (n1 + n0)), pa.bool_()))
    lexicon = {w: i for i, w in enumerate(found.column("w").to_pylist())}  # a subset of the sample's words
    words = docs.sparkSession.createDataFrame([(w,) for w in lexicon], "w string")
    own = rows.select("row", "y").orderBy("row").toArrow()
    order, y = own.column("row").to_numpy(), own.column("y").to_numpy()
    hits = each.join(F.broadcast(words), "w").select("row", "w", "n").toArrow()
    at = np.searchsorted(order, hits.column("row").to_numpy())
    word, n = np.array([lexicon[w] for w in hits.column("w").to_pylist()], int), hits.column("n").to_numpy().astype(float)
    scratch.drop(rows)
    model = Model(characters, lexicon, np.zeros(GROUP + len(lexicon)))
    group = group_features(np.bincount(at, weights=n, minlength=len(y)))
    model.weights = fit_logistic(group, at, word, np.log1p(n), len(lexicon), y)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, restored: bool = False) -> DataFrame:
    """(id, score, predicted) of every row, and with ``restored`` the restored text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.characters)
        for b in pieces(batches):
            texts = strings(b, text_col)
            s = _scores(texts, model, read)
            cols = {id_col: b.column(id_col), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= threshold) for x in s], pa.int32())}
            yield pa.RecordBatch.from_pydict(cols | ({"restored": pa.array([read.text(t) for t in texts])} if restored else {}))

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, predicted int" + ", restored string" * restored)


def _scores(texts: list[str], model: Model, read: Reader) -> list[float]:
    bad = model.lexicon
    return [model.score(Counter(bad[x] for w in read.words(t) for x in w if x in bad)) for t in texts]


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all columns kept; decided where the texts lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.characters)
        for b in pieces(batches):
            yield b.filter(pa.array([x < threshold for x in _scores(strings(b, text_col), model, read)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
