"""Schemas and registers declared in YAML or JSON: loaded on the driver, checked as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import EdgeClass, NodeClass, Property

ENTRY = "section string, name string, taxon string, family string, isolates array<string>, chain struct<taxon:string,accession:string,chains:int>, extra array<string>, moved map<string,string>, note string, has_mondo boolean"


def load_document(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON document from any file system that Spark reads; YAML needs its library, JSON does not."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def schema_of(doc: dict) -> tuple[list[NodeClass], list[EdgeClass], set[str]]:
    """Node classes, edge classes and the predicates that are evaluation labels."""
    nodes = [
        NodeClass(name, tuple(c.get("prefixes") or ()), {k: Property(p.get("type", "string"), bool(p.get("required")), tuple(p.get("values") or ()), p.get("min"), p.get("max")) for k, p in (c.get("properties") or {}).items()})
        for name, c in (doc.get("node_classes") or {}).items()
    ]
    edges = [EdgeClass(e["subject"], e["predicate"], e["object"], bool(e.get("symmetric")), bool(e.get("held_out")), tuple(e.get("required") or ())) for e in doc.get("edge_classes") or []]
    return nodes, edges, {e["predicate"] for e in doc.get("edge_classes") or [] if e.get("evaluation_label")}


def validate_labels(classes: DataFrame, ends: list[str]) -> DataFrame:
    """classes(predicate, object, evaluation_label, held_out) to (predicate, violation): a label must end at one of ``ends`` and be held out."""
    bad = F.array_compact(F.array(F.when(~F.col("object").isin(*ends), "LABEL_BAD_OBJECT"), F.when(~F.coalesce("held_out", F.lit(False)), "LABEL_NOT_HELD_OUT")))
    return classes.where("evaluation_label").select("predicate", F.explode(bad).alias("violation"))


def register_entries(spark: SparkSession, doc: dict, sections: tuple[str, ...] = ("viruses", "surveyed")) -> DataFrame:
    """A register's entries as rows; a family not stated is the default's."""
    rows, default = [], (doc.get("defaults") or {}).get("family")
    for section in sections:
        for v in doc.get(section) or []:
            chain = v.get("chain_source")
            chain = (str(chain.get("taxon") or ""), chain.get("accession"), chain.get("chains")) if isinstance(chain, dict) else None
            rows.append((section, v.get("name"), str(v.get("taxon") or ""), v.get("family") or default, [str(x) for x in v.get("isolate_taxa") or []], chain, list(v.get("extra_accessions") or []), dict(v.get("ppi_accession_map") or {}), v.get("ppi_accession_note"), "mondo" in v))
    return spark.createDataFrame(rows, ENTRY)


def validate_register(entries: DataFrame) -> DataFrame:
    """(section, name, violation) of rows shaped as ``ENTRY``; an entry without a taxon or a chain source ends its own checks there."""
    c, moved = F.col("chain"), F.map_entries("moved")
    carried = F.array_compact(F.concat(F.coalesce("extra", F.array().cast("array<string>")), F.array(c["accession"])))
    any_move = lambda test: F.exists(moved, test)
    chain_taxon = F.coalesce(c["taxon"], F.lit(""))
    first = F.when(F.col("taxon") == "", F.array(F.lit("NO_TAXON")))
    early = F.array(F.when(F.col("repeated"), "DUPLICATE_TAXON"), F.when(F.array_contains("isolates", F.col("taxon")), "ISOLATE_IS_SPECIES"))
    late = F.array(
        F.when(c.isNull(), "NO_CHAIN_SOURCE"),
        F.when(c.isNotNull() & ((chain_taxon == "") | (F.coalesce(c["accession"], F.lit("")) == "") | c["chains"].isNull()), "INCOMPLETE_CHAIN_SOURCE"),
        F.when(c.isNotNull() & (chain_taxon != "") & (chain_taxon != F.col("taxon")) & ~F.array_contains("isolates", chain_taxon), "UNDECLARED_CHAIN_TAXON"),
        F.when(c["chains"] <= 0, "NO_CHAINS"),
        F.when(c.isNotNull() & any_move(lambda e: e["key"] == e["value"]), "PPI_MAP_SELF"),
        F.when(c.isNotNull() & any_move(lambda e: ~F.array_contains(carried, e["value"])), "PPI_MAP_TARGET_NOT_CARRIED"),
        F.when(c.isNotNull() & any_move(lambda e: F.array_contains(carried, e["key"])), "PPI_MAP_SOURCE_IS_CARRIED"),
        F.when(c.isNotNull() & (F.size(moved) > 0) & F.col("note").isNull(), "PPI_MAP_UNEXPLAINED"),
        F.when(c.isNotNull() & ~F.col("has_mondo"), "MONDO_UNSTATED"),
    )
    owner = entries.where("taxon <> ''").groupBy(F.col("taxon").alias("t")).agg(F.min(F.struct("section", "name")).alias("owner"))
    marked = entries.join(owner, entries.taxon == owner.t, "left").withColumn("repeated", F.coalesce(F.struct("section", "name") != F.col("owner"), F.lit(False)))
    return marked.select("section", "name", F.explode(F.array_compact(F.coalesce(first, F.concat(early, late)))).alias("violation"))


def declared_taxa(entries: DataFrame) -> DataFrame:
    """(any_taxon, taxon): every taxon that a source may use for an entry, with the species taxon; a later entry wins."""
    own = F.array_compact(F.concat(F.array("taxon"), F.col("isolates"), F.array(F.nullif(F.col("chain.taxon"), F.lit("")))))
    return entries.select("taxon", F.explode(F.array_distinct(own)).alias("any_taxon")).groupBy("any_taxon").agg(F.max("taxon").alias("taxon"))


def accession_moves(entries: DataFrame) -> DataFrame:
    """(measured, accession): what a measured accession is attributed to; one attributed to two raises when it is read."""
    each = entries.select(F.explode("moved").alias("measured", "accession")).groupBy("measured").agg(F.count_distinct("accession").alias("n"), F.min("accession").alias("accession"))
    return each.select("measured", F.when(F.col("n") == 1, F.col("accession")).otherwise(F.raise_error(F.concat(F.lit("attributed twice: "), "measured")).cast("string")).alias("accession"))


def remap_accessions(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """rows with ``column`` moved to the accession it is attributed to, and what was measured in ``measured_accession``."""
    m = moves.select(F.col("measured").alias("_m"), F.col("accession").alias("_to"))
    out = rows.join(m, F.col(column) == F.col("_m"), "left")
    return out.select(*[F.coalesce("_to", column).alias(column) if x == column else x for x in rows.columns], F.when(F.col("_to").isNotNull(), F.col(column)).alias("measured_accession"))
