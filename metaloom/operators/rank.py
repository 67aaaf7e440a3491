"""Percentiles, ranks, bins and top-k with ties made explicit.

Windows partition by the group columns; a window over all rows is never used on row-sized data: scores
are counted by distinct value first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def value_positions(df: DataFrame, score: str, by: list[str], descending: bool = False) -> DataFrame:
    """(by..., _v, c, below, n): how often a value occurs, how many rows lie before it, rows in all."""
    counts = df.groupBy(*by, F.col(score).alias("_v")).agg(F.count("*").alias("c"))
    order = F.desc("_v") if descending else F.asc("_v")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return counts.withColumn("below", F.sum("c").over(w) - F.col("c")).withColumn("n", F.sum("c").over(whole))


def midrank_percentile(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """df with ``percentile``: mean position of the tie block over n - 1; a single row has 1.0."""
    at = value_positions(df, score, by).withColumn("percentile", F.when(F.col("n") == 1, F.lit(1.0)).otherwise((F.col("below") + (F.col("c") - 1) / 2) / (F.col("n") - 1)))
    keys = [df[k].eqNullSafe(at[k]) for k in by] + [df[score] == at["_v"]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return df.join(at, on).select(df["*"], "percentile")


def average_rank(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """df with ``avg_rank``: the 1-based mean rank of the tie block."""
    at = value_positions(df, score, by).withColumn("avg_rank", F.col("below") + (F.col("c") + 1) / 2)
    on = df[score].eqNullSafe(at["_v"])
    for k in by:
        on = on & df[k].eqNullSafe(at[k])
    return df.join(at, on).select(df["*"], "avg_rank")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``position``; the order must end in a unique key."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)


def equal_count_bins(df: DataFrame, by: list[str], order: list[str], bins: int) -> DataFrame:
    """df with ``bin`` = min(bins - 1, i * bins // n) of the row's position i; not NTILE.

    Rows are sorted over range partitions; a group's positions are its rows' places within a partition plus
    the rows it has in earlier ones, so a group of any size is many tasks' work.
    """
    x = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    x = written(x.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    pieces = x.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy("_part")
    pieces = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_part").alias("_p"), "_first", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return x.join(pieces, on).withColumn("bin", F.least(F.lit(bins - 1), F.floor(place * bins / F.col("_n"))).cast("int")).select(*df.columns, "bin")


def log2_bin(degree: Column) -> Column:
    return F.floor(F.log2(degree)).cast("int")


def hits_range(ranked: DataFrame, score: str, positive: str, by: list[str], k: int) -> DataFrame:
    """Hits in the first k under every order of ties: (by..., pool, positives, hits_min, hits_max, hits_expected, tie_at_cut).

    ``positive`` is a boolean column. Only value counts are ordered. A pool of k rows or fewer is exact.
    """
    counts = ranked.groupBy(*by, F.col(score).alias("_v")).agg(F.count("*").alias("c"), F.sum(F.col(positive).cast("long")).alias("p"))
    w = Window.partitionBy(*by).orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    x = counts.withColumn("before", F.sum("c").over(w) - F.col("c"))
    inside = F.col("before") + F.col("c") <= k
    cut = (F.col("before") < k) & ~inside
    room, own, pos = k - F.col("before"), F.col("c"), F.col("p")
    zero = F.lit(0).cast("long")
    return x.groupBy(*by).agg(
        F.sum("c").alias("pool"),
        F.sum("p").alias("positives"),
        (F.sum(F.when(inside, pos).otherwise(zero)) + F.sum(F.when(cut, F.greatest(zero, room - (own - pos))).otherwise(zero))).alias("hits_min"),
        (F.sum(F.when(inside, pos).otherwise(zero)) + F.sum(F.when(cut, F.least(pos, room)).otherwise(zero))).alias("hits_max"),
        (F.sum(F.when(inside, pos).otherwise(zero)) + F.sum(F.when(cut, pos * room / own).otherwise(F.lit(0.0)))).alias("hits_expected"),
        F.max(F.when(cut & (own > 1), own).otherwise(zero)).alias("tie_at_cut"),
    )


def mrr_range(ranked: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """(by..., mrr_max, mrr_min): the reciprocal rank of the first positive, best and worst within its tie block."""
    counts = ranked.groupBy(*by, F.col(score).alias("_v")).agg(F.count("*").alias("c"), F.sum(F.col(positive).cast("long")).alias("p"))
    w = Window.partitionBy(*by).orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    x = counts.withColumn("before", F.sum("c").over(w) - F.col("c"))
    first = x.where("p > 0").groupBy(*by).agg(F.min_by(F.struct("before", "c", "p"), "before").alias("f"))
    return first.select(*by, (1 / (F.col("f.before") + 1)).alias("mrr_max"), (1 / (F.col("f.before") + F.col("f.c") - F.col("f.p") + 1)).alias("mrr_min"))


def degeneracy(df: DataFrame, score: str) -> DataFrame:
    """One row: rows, distinct values, largest tie, share of rows in a tie."""
    counts = df.groupBy(score).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n_rows"), F.count("*").alias("distinct_values"), F.max("c").alias("largest_tie"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(F.lit(0))) / F.sum("c")).alias("tied_share"))
