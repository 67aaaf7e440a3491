"""Statistics as column arithmetic where a closed form exists, and driver-side scalars for design questions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Z95 = 1.96


def hanley_mcneil(auc: Column, n_pos: Column, n_neg: Column, z: float = Z95) -> Column:
    """(low, high) of an AUC, clipped to 0..1; an empty class gives (0, 1)."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    ok = (n_pos > 0) & (n_neg > 0)
    return F.struct(F.when(ok, F.greatest(F.lit(0.0), auc - z * se)).otherwise(F.lit(0.0)).alias("low"), F.when(ok, F.least(F.lit(1.0), auc + z * se)).otherwise(F.lit(1.0)).alias("high"))


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """(k, lf) for 0..n: a lookup table, since Spark has no log-gamma; n bounds its size."""
    return spark.createDataFrame([(i, math.lgamma(i + 1)) for i in range(n + 1)], "k long, lf double")


def _lchoose(n: Column, k: Column) -> Column:
    """log C(n, k) by the sum of logs over a sequence; for arguments of moderate size."""
    term = F.aggregate(F.sequence(F.lit(1).cast("long"), k.cast("long")), F.lit(0.0), lambda acc, i: acc + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))
    return F.when(k <= 0, F.lit(0.0)).otherwise(term)


def hypergeometric_tail(hits: Column, k: Column, positives: Column, pool: Column) -> Column:
    """P(at least so many positives among k drawn from the pool): null if k >= pool, 0 beyond the possible."""
    top = F.least(k, positives)
    low = F.greatest(hits, F.greatest(F.lit(0).cast("long"), k + positives - pool))
    total = _lchoose(pool, k)
    first = _lchoose(positives, low) + _lchoose(pool - positives, k - low) - total

    def add(acc: Column, i: Column) -> Column:
        ratio = ((positives - i) * (k - i)).cast("double") / ((i + 1) * (pool - positives - k + i + 1))
        return F.struct((acc["sum"] + F.exp(acc["log"])).alias("sum"), F.when(i < top, acc["log"] + F.log(ratio)).otherwise(acc["log"]).alias("log"))

    span = F.when(low <= top, F.sequence(low.cast("long"), top.cast("long"))).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(span, F.struct(F.lit(0.0).alias("sum"), first.alias("log")), add)["sum"]
    return F.when(k >= pool, F.lit(None).cast("double")).when(hits > top, F.lit(0.0)).otherwise(F.least(F.lit(1.0), tail))


def fisher_upper(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided exact p of a 2x2 table; a margin of zero gives 1."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    n, row, col = a + b + c + d, a + b, a + c
    degenerate = (row == 0) | (col == 0) | (c + d == 0) | (b + d == 0)
    return F.when(degenerate, F.lit(1.0)).otherwise(hypergeometric_tail(a, row, col, n))


def poisson_binomial_tail(probabilities: Column, at_least: Column) -> Column:
    """P(sum of independent trials >= at_least): the trials' distribution folded one by one."""
    start = F.array(F.lit(1.0))

    def fold(dist: Column, p: Column) -> Column:
        longer, shifted = F.concat(dist, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), dist)
        return F.zip_with(longer, shifted, lambda stay, up: stay * (1 - p) + up * p)

    dist = F.aggregate(probabilities, start, fold)
    tail = F.slice(dist, at_least.cast("int") + 1, F.greatest(F.size(dist) - at_least.cast("int"), F.lit(0)))
    return F.when(at_least <= 0, F.lit(1.0)).otherwise(F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x))


def empirical_p(extreme: Column, draws: Column) -> Column:
    return (extreme + 1) / (draws + 1)


def minimum_expected_hits(alpha: float) -> float:
    """The expectation under which zero hits are already surprising at alpha."""
    return -math.log(alpha)


def resolvable_steps(alpha: float, draws: int) -> int:
    """Steps of an empirical p at or under alpha."""
    return math.floor(alpha * (draws + 1))


def minimum_detectable_ratio(expected: float, alpha: float) -> float | None:
    """The smallest count that a Poisson of this mean exceeds with probability alpha at most, over the mean."""
    if expected <= 0:
        return None
    below, term, k = 0.0, math.exp(-expected), 0
    while 1 - below > alpha:
        below += term
        k += 1
        term *= expected / k
    return k / expected


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton fit with a penalty on slopes only: (weights, log likelihood). Column 0 is the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -35, 35))), 1e-12, 1 - 1e-12)
    return w, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() - (penalty * w * w).sum() / 2)


def likelihood_ratio(full: float, reduced: float) -> tuple[float, float]:
    """(statistic, p) of one degree of freedom."""
    stat = max(0.0, 2 * (full - reduced))
    return stat, math.erfc(math.sqrt(stat / 2))


def auc_power(auc: float, n_pos: int, n_neg: int, z: float = Z95) -> float:
    """Power to tell an AUC from one half, by the normal approximation."""
    def se(a: float) -> float:
        q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
        return math.sqrt(max(0.0, (a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)) / (n_pos * n_neg)))

    return 0.5 * math.erfc(-((auc - 0.5 - z * se(0.5)) / se(auc)) / math.sqrt(2)) if n_pos and n_neg else 0.0


def detectable_auc(n_pos: int, n_neg: int, power: float = 0.8) -> float:
    """The AUC that is told from one half with the power asked for, by bisection."""
    low, high = 0.5, 1 - 1e-9
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if auc_power(mid, n_pos, n_neg) >= power else (mid, high)
    return high


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    n, row, col = a + b + c + d, a + b, a + c
    if not row or not col or row == n or col == n:
        return 1.0
    return sum(math.comb(col, i) * math.comb(n - col, row - i) for i in range(a, min(row, col) + 1)) / math.comb(n, row)


def screen_power(arm: int, p1: float, p0: float, alpha: float = 0.05) -> float:
    """The exact chance that a two-arm screen of this size rejects: both binomials enumerated."""
    pmf = lambda n, p: [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    one, two = pmf(arm, p1), pmf(arm, p0)
    return sum(u * v for i, u in enumerate(one) for j, v in enumerate(two) if fisher_p(i, arm - i, j, arm - j) <= alpha)


def smallest_arm(p1: float, p0: float, power: float = 0.8, alpha: float = 0.05, most: int = 200) -> int | None:
    return next((n for n in range(2, most + 1) if screen_power(n, p1, p0, alpha) >= power), None)
