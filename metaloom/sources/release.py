"""Releases and delimited sources: readers with explicit schemas, canonical writers and the manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph
from .graph_view import Graph


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_rows(spark: SparkSession, stem: str, schema: str | StructType, nested: dict[str, str] | None = None) -> DataFrame:
    """``stem``.parquet if it is there, else ``stem``.jsonl, else no rows. ``nested`` names text columns that hold JSON, with their types."""
    if exists(spark, f"{stem}.parquet"):
        df = spark.read.parquet(f"{stem}.parquet")
    elif exists(spark, f"{stem}.jsonl"):
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{stem}.jsonl")
    else:
        df = spark.createDataFrame([], schema)
    for c, kind in (nested or {}).items():
        if dict(df.dtypes).get(c) == "string":
            df = df.withColumn(c, F.from_json(c, kind))
    return df


def load_graph(nodes: DataFrame, edges: DataFrame, *, skip_predicates: list[str] | None, symmetric: frozenset[str], drop_shared: DataFrame | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, degree, degree_unlabelled). ``skip_predicates`` must be said, None included: those edges count in the degree and are not walked.

    ``drop_shared`` (subject, publication) takes an edge from the walk, not from either degree, if it
    shares a publication with its subject's labels; edges then need an ``edge_id`` and ``publications``.
    """
    open_ = edges.where(~F.col("predicate").isin(skip_predicates)) if skip_predicates else edges
    walked = open_
    if drop_shared is not None:
        shared = open_.select("edge_id", "subject", F.explode("publications").alias("publication")).join(drop_shared, ["subject", "publication"], "left_semi").select("edge_id").distinct()
        walked = open_.join(shared, "edge_id", "left_anti")
    return Graph(nodes, walked, symmetric), graph.degree(edges), graph.degree(open_)


def write_release(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The working copy: parquet, edges by predicate so that a hop reads its own files only."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    edges.repartition("predicate", F.pmod(F.xxhash64("subject"), F.lit(64))).write.mode("overwrite").partitionBy("predicate").parquet(f"{path}/edges.parquet")


def export_canonical(df: DataFrame, order: list[str], path: str) -> None:
    """JSON lines in one total order over all part files, null fields left out: equal graphs have equal text."""
    cols = sorted(df.columns)
    df.select(*cols).orderBy(*order, *[c for c in cols if c not in order]).write.mode("overwrite").json(path)


def manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, n): counts by class and predicate, and degree figures by nearest rank."""
    deg = graph.degree(edges)
    section = lambda s, df, k: df.select(F.lit(s).alias("section"), F.col(k).alias("name"), F.col("n").cast("long"))
    out = section("class", graph.class_counts(nodes), "class").unionByName(section("predicate", edges.groupBy("predicate").agg(F.count("*").alias("n")), "predicate"))
    cuts = graph.nearest_ranks(deg, "degree", {"p50": 50.0, "p99": 99.0, "p99.9": 99.9, "max": 100.0})
    return out.unionByName(section("degree", cuts.withColumnRenamed("cut", "n"), "name"))


def write_split(train: DataFrame, nodes: DataFrame, labels: DataFrame, path: str, stamp: dict) -> None:
    """A training release: its edges, the nodes that they touch, the label sets (split, group, item, label) and a stamp of where it was cut from."""
    train.write.mode("overwrite").parquet(f"{path}/edges.parquet")
    touched = train.select(F.explode(F.array("subject", "object")).alias("id"))
    nodes.join(touched, "id", "left_semi").write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    labels.write.mode("overwrite").partitionBy("split").parquet(f"{path}/labels.parquet")
    train.sparkSession.createDataFrame([(json.dumps(stamp, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/derived_from")


def result_json(results: object, provenance: dict, refusals: list[str]) -> str:
    """A results document; with refusals it has their reasons and no results."""
    body = {"provenance": provenance} | ({"refused": refusals} if refusals else {"results": results})
    return json.dumps(body, sort_keys=True, indent=1)


# ---------------------------------------------------------------- delimited text


class ColumnError(ValueError):
    pass


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def resolve_header(header: list[str], wanted: dict[str, list[str]], required: list[str]) -> dict[str, str]:
    """Logical field to the header's own spelling, compared by letters and digits only."""
    have = {_plain(h): h for h in header}
    out = {field: have[_plain(s)] for field, spellings in wanted.items() for s in reversed(spellings) if _plain(s) in have}
    missing = [f for f in required if f not in out]
    if missing:
        raise ColumnError(f"no column for {missing} in {header}")
    return out


def read_delimited(spark: SparkSession, path: str, wanted: dict[str, list[str]], required: list[str], sep: str = "\t", comment: str | None = "#") -> DataFrame:
    """Text columns under their logical names; the header is read on the driver, the rows are not."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    names = resolve_header(df.columns, wanted, required)
    return df.select(*[F.col(f"`{h}`").alias(f) for f, h in names.items()])


def banner(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The first group of a pattern in a file's first line."""
    first = spark.read.text(path).limit(1).select(F.regexp_extract("value", pattern, 1).alias("v")).collect()
    return first[0].v or None if first else None


def mitab(lines: DataFrame) -> DataFrame:
    """Interaction rows of tab-separated lines of 15 columns or more: identifiers (a chain beats an accession), method, author, publication, taxa, type, source, score."""
    c = F.split(F.col("value"), "\t")
    at = lambda i: F.get(c, F.lit(i))

    def identifier(x: Column) -> Column:
        chain = F.regexp_extract(x, r"uniprotkb:([A-Z0-9]+-PRO_[0-9]+)", 1)
        plain = F.regexp_extract(x, r"uniprotkb:([A-Z0-9]+)", 1)
        return F.when(chain != "", chain).when(plain != "", plain)

    label = lambda x: F.nullif(F.regexp_extract(x, r"\(([^()]*)\)", 1), F.lit(""))
    taxon = lambda x: F.regexp_extract(x, r"taxid:(-?[0-9]+)", 1).try_cast("long")
    return lines.where(~F.col("value").startswith("#") & (F.size(c) >= 15)).select(
        identifier(at(0)).alias("a"), identifier(at(1)).alias("b"), label(at(6)).alias("method"), at(7).alias("author"), F.nullif(F.regexp_extract(at(8), r"pubmed:([0-9]+)", 1), F.lit("")).alias("publication"),
        taxon(at(9)).alias("taxon_a"), taxon(at(10)).alias("taxon_b"), label(at(11)).alias("type"), label(at(12)).alias("source"), F.regexp_extract(at(14), r"([0-9.]+)", 1).try_cast("double").alias("score"),
    )


def aliases(lines: DataFrame, source: str) -> DataFrame:
    """(protein, alias) of three-column rows of one source; comment lines are skipped."""
    c = F.split(F.col("value"), "\t")
    return lines.where(~F.col("value").startswith("#") & (F.size(c) == 3)).select(c[0].alias("protein"), c[1].alias("alias"), c[2].alias("source")).where(F.col("source") == source).drop("source")


def undirected_links(links: DataFrame, score: str, least: float) -> DataFrame:
    """One row per unordered pair with a score over the bound; of reciprocal rows the first (by ordinal) counts."""
    x = links.where((F.col(score) >= least) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(score).alias("s"), "ordinal")
    return x.groupBy("a", "b").agg(F.min_by("s", "ordinal").alias(score))


def strict_rows(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, (row, violation) of the others)."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    x = rows.withColumn("_bad", bad)
    return x.where(F.size("_bad") == 0).drop("_bad"), x.select("row", F.explode("_bad").alias("violation"))


def ontology_labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, label) and (xref, id) of graphs[0].nodes[]; deprecated terms have no xrefs, an xref of several terms is ambiguous and left out."""
    n = docs.select(F.explode(F.col("graphs")[0]["nodes"]).alias("n"))
    labels = n.select(F.col("n.id").alias("id"), F.col("n.lbl").alias("label")).where("label is not null")
    live = n.where(~F.coalesce(F.col("n.meta.deprecated"), F.lit(False)))
    refs = live.select(F.explode("n.meta.xrefs").alias("x"), F.col("n.id").alias("id")).select(F.col("x.val").alias("xref"), "id").distinct()
    return labels, refs.groupBy("xref").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("xref", "id")
