"""Quality classifier: a sparse ensemble of rules compiled into Spark column expressions.

Statistics of a text are Spark columns. Shallow trees are grown on a labelled sample (at most
``SAMPLE_ROWS`` rows, the only bound), every path from a root to a node becomes a conjunctive rule, a
lasso-penalised logistic regression keeps few of the rules, and those are compiled back into one column
expression: scoring is a projection, without Python.

Edge cases: null and empty texts have the statistics of an empty text and get a score; labels that are
null are left out, of rows that repeat an id in the labels the largest label counts; without labels of
both classes the score is the smoothed share of label 1; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

SAMPLE_ROWS, TREES, DEPTH, PENALTY = 20_000, 24, 3, 2e-3

_SETS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ",
    "digit": "0123456789",
    "symbol": "!|*$%&#@^~<>{}[]=\\_/+",
    "stop": ".,;:?",
}
STATISTICS = ("chars", "words", "word_length", "distinct_words", "distinct_lines", "line_length", *_SETS)


def statistics(text: Column) -> dict[str, Column]:
    """Columns of a text's statistics. Counts are on a log scale; shares are of characters, words or lines."""
    t = F.coalesce(text, F.lit(""))
    words, lines, n = F.split(t, r"\s+"), F.split(t, "\n"), F.greatest(F.length(t), F.lit(1))
    share = {k: 1 - F.length(F.translate(t, v, "")) / n for k, v in _SETS.items()}
    out = {
        "chars": F.log1p(F.length(t).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(t) / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(F.length(t) / F.size(lines)),
    } | {k: F.when(F.length(t) == 0, F.lit(0.0)).otherwise(c) for k, c in share.items()}
    return {k: out[k] for k in STATISTICS}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_greater, bound)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, greater, bound in self.terms:
            out &= (x[:, f] > bound) if greater else (x[:, f] <= bound)
        return out

    def column(self, names: list[str] = list(STATISTICS)) -> Column:
        out = F.lit(True)
        for f, greater, bound in self.terms:
            out = out & (F.col(names[f]) > bound if greater else F.col(names[f]) <= bound)
        return out


def grow(x: np.ndarray, residual: np.ndarray, depth: int, features: np.ndarray, terms: tuple = ()) -> list[tuple[Rule, float]]:
    """A regression tree's nodes as (rule, mean residual), leaves last; splits lie between sample quantiles."""
    if depth == 0 or len(x) < 10:
        return []
    best = (1e-9, None)
    total, n = residual.sum(), len(residual)
    for f in features:
        for bound in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))):
            left = x[:, f] <= bound
            m = left.sum()
            if 5 <= m <= n - 5:
                s = residual[left].sum()
                gain = s * s / m + (total - s) ** 2 / (n - m) - total * total / n
                if gain > best[0]:
                    best = (gain, (int(f), float(bound), left))
    if best[1] is None:
        return []
    f, bound, left = best[1]
    out = []
    for greater, rows in ((False, left), (True, ~left)):
        own = (*terms, (f, greater, bound))
        out.append((Rule(own), float(residual[rows].mean())))
        out += grow(x[rows], residual[rows], depth - 1, features, own)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows and of the statistics."""
    rng, score, rules = np.random.default_rng(5), np.full(len(y), y.mean()), {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        features = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        nodes = grow(x[rows], (y - score)[rows], depth, features)
        depth_of = max((len(r.terms) for r, _ in nodes), default=0)
        for rule, mean in nodes:
            rules.setdefault(rule)
            if len(rule.terms) == depth_of:
                score = score + 0.3 * mean * rule.holds(x)
    return list(rules)


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    z = z.astype(np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    rate = 4.0 * len(y) / max(1.0, np.linalg.norm(np.column_stack([z, np.ones(len(z))]), 2) ** 2)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -40, 40)))
        g = (p - y) / len(y)
        nw = vw - rate * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The probability of label 1, over the columns that ``statistics`` names."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = extract_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    b, w = fit_lasso(np.column_stack([r.holds(x) for r in rules]), y)
    return RuleModel(float(b), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6))


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` training labels (crc32 of the id modulo 5 not 0), those of the smallest id hashes: (id, y)."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), 5) != 0)).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    sample = labelled_sample(labels, label_col, id_col)
    own = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # at most SAMPLE_ROWS rows
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    one = own.select(F.col(id_col).alias("id"), "y", stats.alias("s")).groupBy("id", "y").agg(F.min("s").alias("s"))  # rows that repeat an id count once
    got = one.select("id", "y", "s.*").toArrow().sort_by([("id", "ascending")])  # sorted here: a sort in Spark would read the texts twice
    return fit(np.column_stack([got.column(k).to_numpy() for k in STATISTICS]).astype(np.float64), got.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row."""
    stats = docs.select(F.col(id_col), *[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    scored = stats.select(id_col, model.column().alias("score"))
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
