"""Splits at a cutoff year, and the audit that nothing later leaks into training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(edges: DataFrame) -> DataFrame:
    """(id, year): the first year in which a node has a dated edge; undated nodes have null."""
    return edges.select(F.explode(F.array("subject", "object")).alias("id"), "year").groupBy("id").agg(F.min("year").alias("year"))


def date_computed(edges: DataFrame, computed: list[str]) -> DataFrame:
    """edges with undated edges of computed sources dated by the later of their ends' first years (null if either has none)."""
    seen = first_seen(edges)
    s, o = seen.select(F.col("id").alias("subject"), F.col("year").alias("_s")), seen.select(F.col("id").alias("object"), F.col("year").alias("_o"))
    own = F.col("year").isNull() & F.col("source").isin(computed) & F.col("_s").isNotNull() & F.col("_o").isNotNull()
    joined = edges.join(s, "subject", "left").join(o, "object", "left")
    return joined.select(*[F.when(own, F.greatest("_s", "_o")).otherwise(F.col("year")).alias(c) if c == "year" else F.col(c) for c in edges.columns])


def training_edges(edges: DataFrame, cutoff: int, held_out: list[str], undated: str = "include", computed: list[str] = ()) -> DataFrame:
    """Edges that training may see: not held out, not after the cutoff; undated ones by policy."""
    if undated not in ("include", "exclude", "computed_only"):
        raise ValueError(f"no such policy: {undated}")
    unknown = {"include": F.lit(True), "exclude": F.lit(False), "computed_only": F.col("source").isin(list(computed))}[undated]
    return edges.where(~F.col("predicate").isin(held_out) & F.when(F.col("year").isNull(), unknown).otherwise(F.col("year") <= cutoff))


def split_labels(rows: DataFrame, cutoff: int, overlap: str = "drop-from-test") -> DataFrame:
    """(side, virus, compound, label) of (virus, compound, verdict, year): contested pairs leave a side; a pair known in training with the same answer leaves the test side."""
    sides = rows.where(F.col("verdict").isNotNull() & F.col("year").isNotNull()).withColumn("side", F.when(F.col("year") <= cutoff, "train").otherwise("test"))
    one = sides.groupBy("side", "virus", "compound").agg(F.bool_or("verdict").alias("a"), F.bool_or(~F.col("verdict")).alias("i")).where("a <> i").select("side", "virus", "compound", F.col("a").alias("label"))
    if overlap == "keep":
        return one
    known = one.where("side = 'train'").select("virus", "compound", "label")
    test = one.where("side = 'test'").join(known, ["virus", "compound", "label"], "left_anti").select(*one.columns)
    return one.where("side = 'train'").unionByName(test)


def audit(train: DataFrame, labels: DataFrame, cutoff: int, held_out: list[str]) -> DataFrame:
    """(check, n): training edges after the cutoff, held-out training edges, test pairs with no training edge at their compound, pairs on both sides. All should be 0 but the third."""
    nodes = train.select(F.explode(F.array("subject", "object")).alias("compound")).distinct()
    test, known = labels.where("side = 'test'"), labels.where("side = 'train'")
    checks = [
        ("future_edges", train.where(F.col("year") > cutoff)),
        ("held_out_edges", train.where(F.col("predicate").isin(held_out))),
        ("unreachable_test", test.join(nodes, "compound", "left_anti")),
        ("label_overlap", test.join(known.select("virus", "compound", "label"), ["virus", "compound", "label"], "left_semi")),
    ]
    out = None
    for name, df in checks:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def year_histogram(edges: DataFrame, batch_dated: list[str] = ()) -> DataFrame:
    """(source, year, n) by each part of "|"-separated sources; null is undated; batch-dated sources can be left out."""
    x = edges.select(F.explode(F.array_distinct(F.split("source", r"\|"))).alias("source"), "year")
    if batch_dated:
        x = x.where(~F.col("source").isin(list(batch_dated)))
    return x.groupBy("source", "year").agg(F.count("*").alias("n"))
