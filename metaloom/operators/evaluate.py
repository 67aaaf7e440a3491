"""Evaluation against measured labels: AUC with imputation, coverage bounds, lift, overlap and permutation nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import rank


def label_sets(rows: DataFrame, group: str, item: str, verdict: str) -> DataFrame:
    """(group, item, label): items with one kind of verdict only; contested ones leave both sets."""
    x = rows.where(F.col(verdict).isNotNull()).groupBy(group, item).agg(F.bool_or(verdict).alias("a"), F.bool_or(~F.col(verdict)).alias("i"))
    return x.where(F.col("a") != F.col("i")).select(group, item, F.col("a").alias("label"))


def auc(scores: DataFrame, labels: DataFrame, by: list[str], item: str) -> DataFrame:
    """AUC of each group over its whole label set.

    Labelled items without a score get the least of all the group's scores less one (-1 without scores), so
    they tie with each other. Returns (by..., n_pos, n_neg, pos_scored, neg_scored, auc, low, high, floor,
    ceiling, skill); the rank sum comes from counts by value.
    """
    least = scores.groupBy(*by).agg((F.min("score") - 1).alias("imputed"))
    x = labels.join(scores.select(*by, item, "score"), [*by, item], "left").join(least, by, "left")
    x = x.select(*by, "label", F.col("score").isNotNull().alias("scored"), F.coalesce("score", "imputed", F.lit(-1.0)).alias("s"))
    at = rank.value_positions(x, "s", by).select(*by, "_v", (F.col("below") + (F.col("c") + 1) / 2).alias("midrank"))
    counts = x.groupBy(*by, "s").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("p", F.col("label")), ("q", ~F.col("label")), ("ps", F.col("label") & F.col("scored")), ("qs", ~F.col("label") & F.col("scored")))])
    joined = counts.join(at.withColumnRenamed("_v", "s"), [*by, "s"])
    g = joined.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("ps").alias("pos_scored"), F.sum("qs").alias("neg_scored"), F.sum(F.col("p") * F.col("midrank")).alias("rs"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    n1, n0, s1, s0 = (F.col(c) for c in ("n_pos", "n_neg", "pos_scored", "neg_scored"))
    g = g.withColumn("auc", F.when(both, (F.col("rs") - n1 * (n1 + 1) / 2) / (n1 * n0)))
    unseen = (n1 - s1) * (n0 - s0) / 2
    g = g.withColumn("ceiling", F.when(both, (s1 * n0 + unseen) / (n1 * n0))).withColumn("floor", F.when(both, (s1 * s0 / 2 + s1 * (n0 - s0) + unseen) / (n1 * n0)))
    span = F.col("ceiling") - F.col("floor")
    interval = stats.hanley_mcneil(F.col("auc"), n1, n0)
    return g.select(*by, "n_pos", "n_neg", "pos_scored", "neg_scored", "auc", F.when(both, interval["low"]).otherwise(F.lit(0.0)).alias("low"), F.when(both, interval["high"]).otherwise(F.lit(1.0)).alias("high"), "floor", "ceiling", F.when(span > 1e-12, (F.col("auc") - F.col("floor")) / span).alias("skill"))


def lift(scores: DataFrame, positive: str, by: list[str], k: int, score: str = "score") -> DataFrame:
    """A lift row per group: hits in the first k with their tie range, expectation, lift, MRR range and tail probability."""
    hits, mrr = rank.hits_range(scores, score, positive, by, k), rank.mrr_range(scores, score, positive, by)
    drawn = F.least(F.lit(k).cast("long"), F.col("pool"))
    x = hits.join(mrr, by, "left").withColumn("expected", F.col("positives") * drawn / F.col("pool"))
    tail = stats.hypergeometric_tail(F.col("hits_min"), F.lit(k).cast("long"), F.col("positives"), F.col("pool"))
    return x.withColumns({"lift_min": F.when(F.col("expected") > 0, F.col("hits_min") / F.col("expected")), "lift_max": F.when(F.col("expected") > 0, F.col("hits_max") / F.col("expected")), "p_min": tail})


def combine_channels(scored: DataFrame, weights: DataFrame, by: list[str], channel: str, item: str) -> DataFrame:
    """(by..., item, score): the largest percentile x weight over channels; a channel without weight says nothing."""
    pct = rank.midrank_percentile(scored, "score", [*by, channel])
    return pct.join(weights, channel).groupBy(*by, item).agg(F.max(F.col("percentile") * F.col("weight")).alias("score"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by..., rho): Pearson's correlation of average ranks; null where a side has no spread."""
    x = rank.average_rank(rank.average_rank(df, a, by).withColumnRenamed("avg_rank", "ra"), b, by).withColumnRenamed("avg_rank", "rb")
    g = x.groupBy(*by).agg(F.corr("ra", "rb").alias("rho"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return g.select(*by, F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("rho")).alias("rho"))


def overlap(sets: DataFrame, reference: DataFrame, universe: DataFrame, by: str, item: str) -> DataFrame:
    """(by, set_size, hits, expected, p): each set's overlap with the reference in the universe, with Fisher's exact tail."""
    u = universe.select(item).distinct()
    ref = reference.select(item).distinct().join(u, item, "left_semi").withColumn("is_ref", F.lit(True))
    own = sets.select(by, item).distinct().join(u, item, "left_semi").join(ref, item, "left")
    size = u.agg(F.count("*").alias("n_universe")).join(F.broadcast(ref.agg(F.count("*").alias("n_ref"))))
    x = own.groupBy(by).agg(F.count("*").alias("set_size"), F.count("is_ref").alias("hits")).join(F.broadcast(size))
    a, n, r, u_ = F.col("hits"), F.col("set_size"), F.col("n_ref"), F.col("n_universe")
    return x.select(by, "set_size", "hits", (n * r / u_).alias("expected"), stats.fisher_upper(a, n - a, r - a, u_ - n - r + a).alias("p"))


def binned_null(binned: DataFrame, by: list[str], bin_col: str, chosen: str, marked: str) -> DataFrame:
    """(by..., observed, mean, variance): marked items among the chosen against draws without replacement from the same bins, in closed form."""
    g = binned.groupBy(*by, bin_col).agg(*[F.sum(F.col(c).cast("long")).alias(n) for n, c in (("k", chosen), ("m", marked))], F.count("*").alias("n"), F.sum((F.col(chosen) & F.col(marked)).cast("long")).alias("o"))
    k, m, n = F.col("k"), F.col("m"), F.col("n")
    var = F.when(n > 1, k * (m / n) * (1 - m / n) * (n - k) / (n - 1)).otherwise(F.lit(0.0))
    return g.groupBy(*by).agg(F.sum("o").alias("observed"), F.sum(k * m / n).alias("mean"), F.sum(var).alias("variance"))


def permutation_draws(binned: DataFrame, by: list[str], bin_col: str, chosen: str, marked: str, draws: int, seed: int = 0) -> DataFrame:
    """(by..., draw, hits): seeded draws of each bin's demand without replacement; bins are sampled group by group in numpy."""
    import numpy as np
    import pandas as pd

    g = binned.groupBy(*by, bin_col).agg(F.sum(F.col(chosen).cast("long")).alias("k"), F.sum(F.col(marked).cast("long")).alias("m"), F.count("*").alias("n"))

    def draw(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                rng = np.random.default_rng([seed, *"|".join(str(getattr(row, c)) for c in (*by, bin_col)).encode()])
                hits = rng.hypergeometric(row.m, row.n - row.m, min(row.k, row.n), draws)
                out.append(pd.DataFrame({c: [getattr(row, c)] * draws for c in by} | {"draw": range(draws), "hits": hits}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*by, "draw", "hits"])

    kinds = ", ".join(f"{c} {binned.schema[c].dataType.simpleString()}" for c in by)
    return g.mapInPandas(draw, f"{kinds}, draw int, hits long").groupBy(*by, "draw").agg(F.sum("hits").alias("hits"))


def size_matched(rows: DataFrame, size: Column, target: int, floor: int) -> DataFrame:
    """One row (samples, hits, rate): the nearest sizes to the target, taken in order until there are ``floor`` samples."""
    x = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("hit").alias("h")).withColumn("far", F.abs(F.col("size") - target))
    w = Window.orderBy("far", "size").rowsBetween(Window.unboundedPreceding, -1)  # over distinct sizes
    x = x.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return x.where(F.col("before") < floor).agg(F.sum("n").alias("samples"), F.sum("h").alias("hits"), (F.sum("h") / F.sum("n")).alias("rate"))


def weighted_lower_median(rows: DataFrame, value: str) -> DataFrame:
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    x = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return x.join(F.broadcast(total)).where(F.col("upto") * 2 >= F.col("n")).agg(F.min("v").alias("median"))
