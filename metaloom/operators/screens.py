"""Screens: funnels, gates, counterscreens and checks of declared polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PolarityError(ValueError):
    """An assay's own rows disagree with the sign declared for it."""


def observed_polarity(rows: DataFrame, by: list[str], fitted: Column, efficacy: Column, least: float) -> DataFrame:
    """(by..., sign, negative, positive) over fitted strong responders; equal numbers state no sign (0)."""
    strong = rows.where(fitted & (F.abs(efficacy) >= least))
    out = strong.groupBy(*by).agg(F.count_if(efficacy < 0).alias("negative"), F.count_if(efficacy >= 0).alias("positive"))
    return out.withColumn("sign", F.signum(F.col("positive") - F.col("negative")).cast("int"))


def check_polarity(observed: DataFrame, declared: DataFrame, by: list[str]) -> DataFrame:
    """Assays whose responders contradict the declared sign, or state none: (by..., sign, declared, negative, positive)."""
    both = declared.join(observed, by, "left").select(*by, F.coalesce("sign", F.lit(0)).alias("sign"), "declared", F.coalesce("negative", F.lit(0)).cast("long").alias("negative"), F.coalesce("positive", F.lit(0)).cast("long").alias("positive"))
    return both.where(F.col("sign") != F.col("declared"))


def refuse_polarity(observed: DataFrame, declared: DataFrame, by: list[str]) -> None:
    """Raises for the first assays that contradict their declaration."""
    wrong = check_polarity(observed, declared, by).orderBy(*by).take(5)
    if wrong:
        raise PolarityError(f"declared signs contradict the rows: {[r.asDict() for r in wrong]}")


def first_counterscreen(rows: DataFrame, sample: str, ordinal: str, only: Column | None = None) -> DataFrame:
    """A sample's first counterscreen row by ordinal; rows without a sample are left out. One aggregate, no window."""
    own = rows.where(only) if only is not None else rows
    own = own.where(F.col(sample).isNotNull() & (F.trim(F.col(sample).cast("string")) != ""))
    return own.groupBy(sample).agg(F.min_by(F.struct(*[c for c in rows.columns if c != sample]), ordinal).alias("x")).select(sample, "x.*")


def counterscreened(primary: DataFrame, counter: DataFrame, sample: str, value: str) -> DataFrame:
    """Primary rows with the value of their sample's counterscreen, null where it has none."""
    return primary.join(counter.select(sample, F.col(value).alias(f"counter_{value}")), sample, "left")


def assay_type_filter(rows: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of an allowed type, (type, n) of the others)."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return rows.where(ok), rows.where(~ok).groupBy(F.coalesce(column, F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def dose_series(rows: DataFrame, flag: Column, policy: str) -> tuple[DataFrame, DataFrame]:
    """(rows, one row of how many the flag kept or excluded) under the policy "include" or "exclude"."""
    if policy not in ("include", "exclude"):
        raise ValueError(f"unknown policy {policy!r}")
    flagged = F.coalesce(flag, F.lit(False))
    kept = rows.where(~flagged) if policy == "exclude" else rows
    fate = "outside_dose_series_excluded" if policy == "exclude" else "outside_dose_series_kept"
    return kept, rows.where(flagged).agg(F.lit(fate).alias("fate"), F.count("*").alias("n"))


def funnel(screens: DataFrame, by: list[str], matched: Column, usable: Column, processed: Column) -> DataFrame:
    """(by..., screens, matched, usable, processed): every step counts rows that passed all before it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    a, b, c = yes(matched), yes(matched) & yes(usable), yes(matched) & yes(usable) & yes(processed)
    return screens.groupBy(*by).agg(F.count("*").alias("screens"), F.count_if(a).alias("matched"), F.count_if(b).alias("usable"), F.count_if(c).alias("processed"))


def silent_taxa(funnels: DataFrame, taxa: DataFrame, key: str) -> DataFrame:
    """(key, reason) of taxa without a processed screen: the first step at which the last screen was lost."""
    reason = F.when(F.coalesce("matched", F.lit(0)) == 0, "no screen").when(F.col("usable") == 0, "none usable").when(F.col("processed") == 0, "none processed")
    return taxa.join(funnels, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def fetchable(screens: DataFrame, usable: Column, override: DataFrame, key: str) -> DataFrame:
    """Screens that are usable or named in the override (key)."""
    named = override.select(key).distinct().withColumn("_named", F.lit(True))
    return screens.join(named, key, "left").where(F.coalesce(usable, F.lit(False)) | F.coalesce("_named", F.lit(False))).drop("_named")


def join_report(labelled: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: emitted, already_in_graph, new_compounds, join_rate over distinct keys."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    out = labelled.select(key).distinct().join(known, key, "left").agg(F.count("*").alias("emitted"), F.count("_known").alias("already_in_graph"))
    return out.select("emitted", "already_in_graph", (F.col("emitted") - F.col("already_in_graph")).alias("new_compounds"), F.when(F.col("emitted") > 0, F.col("already_in_graph") / F.col("emitted")).otherwise(F.lit(0.0)).alias("join_rate"))
