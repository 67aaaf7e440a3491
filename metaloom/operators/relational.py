"""Scans of a relational assay database: joins declared once, sides left to adaptive execution.

Rules that a plan must not decide are kept as columns: the activity id is the ordinal that says which row
comes first, and mechanisms carry an ordinal by which the last row wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.assay_view import Assays

# The result types that state a potency; the taxon of human proteins.
POTENCY_TYPES = ("IC50", "EC50", "Ki", "Kd")
HUMAN = 9606


def activity_scan(db: Assays, taxa: Iterable[int], types: Iterable[str] = POTENCY_TYPES) -> DataFrame:
    """Measured activities against targets of the taxa, with what structure, document and component there is.

    No taxon is a caller's mistake, not an empty answer: ValueError. A target of several components gives a
    row for each.
    """
    taxa = sorted(set(taxa))
    if not taxa:
        raise ValueError("no taxa: an empty list would read as a virus without data")
    act = db.activities.where(F.col("standard_value").isNotNull() & F.col("standard_type").isin(*types))
    own = db.targets.where(F.col("tax_id").isin(taxa))
    return (
        act.join(db.assays.join(own, "tid"), "assay_id").join(db.molecules.select("molregno", "compound", "max_phase", F.col("name").alias("drug_name")), "molregno")
        .join(db.structures, "molregno", "left").join(db.documents, "doc_id", "left").join(db.components, "tid", "left").join(db.sequences, "component_id", "left")
        .select("activity_id", "compound", "smiles", "inchikey", "max_phase", "drug_name", "target", "target_name", "target_type", "tax_id", "accession", "standard_type", "standard_value", "standard_units", "standard_relation", "description", "assay_type", "assay", "doc_id", "comment", "year", "pubmed_id")
    )


def host_target_scan(db: Assays, least_potency: float, least_phase: int, known: DataFrame | None = None, taxon: int = HUMAN, types: Iterable[str] = POTENCY_TYPES) -> DataFrame:
    """Single-protein potencies of a host for compounds of the phase, or of any phase where ``known`` (inchikey) has them.

    An unphased compound is kept just where it is known.
    """
    act = db.activities.where((F.col("pchembl_value") >= least_potency) & F.col("standard_type").isin(*types))
    own = db.targets.where((F.col("tax_id") == taxon) & (F.col("target_type") == "SINGLE PROTEIN")).join(db.components, "tid").join(db.sequences, "component_id")
    rows = act.join(db.assays.join(own, "tid"), "assay_id").join(db.molecules.select("molregno", "compound", "max_phase"), "molregno").join(db.structures, "molregno", "left").join(db.documents, "doc_id", "left")
    allowed: Column = F.coalesce(F.col("max_phase") >= least_phase, F.lit(False))
    if known is not None:
        rows = rows.join(known.select("inchikey").distinct().withColumn("known", F.lit(True)), "inchikey", "left")
        allowed = allowed | F.coalesce("known", F.lit(False))
    return rows.where(allowed).select("activity_id", "compound", "max_phase", "smiles", "inchikey", "accession", "standard_type", "standard_value", "standard_units", "standard_relation", "pchembl_value", "assay_type", "assay", "year", "pubmed_id")


def mechanism_scan(db: Assays) -> DataFrame:
    """(compound, accession, action_type): stated actions only; of a pair's several the last by ordinal counts."""
    rows = db.mechanisms.where("action_type is not null").join(db.molecules.select("molregno", "compound"), "molregno").join(db.components, "tid").join(db.sequences.where("accession is not null"), "component_id")
    return rows.groupBy("compound", "accession").agg(F.max_by("action_type", "ordinal").alias("action_type"))


def indication_scan(db: Assays, diseases: DataFrame, registry: str = "ClinicalTrials") -> DataFrame:
    """(disease, inchikey, max_phase_for_ind, ref_id) for diseases(disease, mesh array, efo array), all at once.

    A row without a registry reference comes back with null, so that it can be counted; an indication that
    matches by both kinds of id counts once.
    """
    by = lambda ids, col: db.indications.join(diseases.select("disease", F.explode(ids).alias(col)), col).select("disease", *db.indications.columns)
    own = by("mesh", "mesh_id").unionByName(by("efo", "efo_id")).dropDuplicates(["disease", "drugind_id"])
    trials = db.references.where(F.col("ref_type") == registry).select("drugind_id", "ref_id")
    return own.join(db.structures.select("molregno", "inchikey"), "molregno").join(trials, "drugind_id", "left").select("disease", "inchikey", "max_phase_for_ind", "ref_id")


def annotations(db: Assays) -> DataFrame:
    """(molregno, compound, name, atc, withdrawn, black_box, therapeutic): classes sorted and joined, one row a molecule."""
    classes = db.classes.groupBy("molregno").agg(F.array_join(F.array_sort(F.collect_set("level5")), ",").alias("atc"))
    return db.molecules.join(classes, "molregno", "left").select("molregno", "compound", F.nullif("name", F.lit("")).alias("name"), F.coalesce("atc", F.lit("")).alias("atc"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("withdrawn", "black_box", "therapeutic")])


def annotate(compounds: DataFrame, db: Assays) -> DataFrame:
    """compounds(id, compound, inchikey) with name, atc and flags: by compound id, else by key; ``matched`` says by which, null if neither."""
    known = annotations(db)
    cols = ["name", "atc", "withdrawn", "black_box", "therapeutic"]
    a = known.select("compound", F.struct(*cols).alias("a"))
    b = known.join(db.structures, "molregno").select("inchikey", F.struct(*cols).alias("b"))
    both = compounds.join(a, "compound", "left").join(b, "inchikey", "left").withColumn("x", F.coalesce("a", "b"))
    return both.select("id", F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "key").alias("matched"), *[F.col(f"x.{c}").alias(c) for c in cols])


def readout_predicate(rows: DataFrame, cellular: Column, verdict: Column) -> DataFrame:
    """Chemistry rows as edges: an organism or a cellular readout is an activity, else the verdict decides; one row for each
    (compound, predicate, target, assay, standard_type), the first by activity id."""
    predicate = F.when((F.col("target_type") == "ORGANISM") | cellular, "ACTIVE_AGAINST").when(verdict == "active", "INHIBITS").when(verdict == "inactive", "MEASURED_INACTIVE")
    keys = ["compound", "predicate", "target", "assay", "standard_type"]
    return rows.withColumn("predicate", predicate).where("predicate is not null").groupBy(*keys).agg(F.min_by("standard_value", "activity_id").alias("standard_value"), F.count("*").alias("support"))


def accounting(fates: DataFrame, emitted: list[str], dropped: list[str]) -> DataFrame:
    """(scanned, emitted, dropped, unlisted) of fates(fate, n): a fate on neither list is unaccounted."""
    of = lambda names: F.coalesce(F.sum(F.when(F.col("fate").isin(*names), F.col("n"))), F.lit(0)).cast("long")
    return fates.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"), of(emitted).alias("emitted"), of(dropped).alias("dropped"), F.coalesce(F.sum(F.when(~F.col("fate").isin(*emitted, *dropped), F.col("n"))), F.lit(0)).cast("long").alias("unlisted"))


def survey_targets(targets: DataFrame, family: Column, role: Column) -> DataFrame:
    """Targets with their family and role; those of neither are left out."""
    out = targets.withColumn("family", family).withColumn("role", role)
    return out.where("family is not null or role is not null")


def publication_shares(rows: DataFrame) -> DataFrame:
    """(role, compound, documents, organisms): how many documents and organisms a compound has in each role."""
    return rows.groupBy("role", "compound").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("tax_id").alias("organisms"))


def verdict_sets(rows: DataFrame) -> DataFrame:
    """(compound, verdicts): the distinct verdicts of each compound, sorted and joined."""
    return rows.where("verdict is not null").groupBy("compound").agg(F.array_join(F.array_sort(F.collect_set("verdict")), "|").alias("verdicts"))
