"""Per-source transforms: gates, screens, selectivity, interactions, indications and identifier recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

UNINFORMATIVE_BOUND = 10.0


# ---------------------------------------------------------------- selectivity


def selectivity_pairs(activity: DataFrame, toxicity: DataFrame) -> DataFrame:
    """(compound, document, virus, cc50, ec50, exact, si): measurements of one document matched per compound.

    The cytotoxic value is the least exact one, else the least bound; the effective one is the greatest on
    the same cell line, else the greatest of all. Both sides are aggregated before they meet.
    """
    tox = toxicity.groupBy("compound", "document").agg(F.min_by(F.struct("nm", "cell"), F.struct((~F.col("exact")).alias("o"), "nm", "cell")).alias("c"), F.bool_or("exact").alias("exact"))
    act = activity.groupBy("compound", "document", "virus").agg(F.collect_list(F.struct("nm", "cell")).alias("rows"))
    x = act.join(tox, ["compound", "document"])
    own = F.filter("rows", lambda r: r["cell"] == F.col("c.cell"))
    value = F.array_max(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("rows")), lambda r: r["nm"]))
    x = x.select("compound", "document", "virus", F.col("c.nm").alias("cc50"), value.alias("ec50"), "exact")
    return x.withColumn("si", scalar.selectivity(F.col("cc50"), F.col("ec50")))


def selectivity_summary(pairs: DataFrame) -> DataFrame:
    """(compound, virus, si, si_max, n): the median of exact values where there are any, else the strongest bound; bounds under 10 say nothing."""
    kept = pairs.where(F.col("si").isNotNull() & (F.col("exact") | (F.col("si") >= UNINFORMATIVE_BOUND)))
    g = kept.groupBy("compound", "virus").agg(F.expr("percentile(si, 0.5) FILTER (WHERE exact)").alias("exact_si"), F.max(F.when(~F.col("exact"), F.col("si"))).alias("bound"), F.max("si").alias("si_max"), F.count("*").alias("n"))
    return g.select("compound", "virus", F.coalesce("exact_si", "bound").alias("si"), "si_max", "n")


# ---------------------------------------------------------------- screens


def curve_class(text: Column) -> tuple[Column, Column]:
    """(class, sign) of a signed class such as "-2.1"."""
    n = text.try_cast("double")
    return F.abs(n), F.when(n < 0, F.lit(-1)).when(n > 0, F.lit(1)).otherwise(F.lit(0))


def screen_verdict(klass: Column, efficacy: Column, polarity: Column, ac50_um: Column, cytotoxic: Column, top_um: Column, least_efficacy: float = 50.0, most_um: float = 10.0) -> Column:
    """struct(active, reason, value_um): class 4 is inactive at the top concentration; a fitted curve is active if strong and potent; the rest is undecided."""
    strong = efficacy * polarity >= least_efficacy
    out = lambda active, reason, v: F.struct(F.lit(active).cast("boolean").alias("active"), F.lit(reason).alias("reason"), v.cast("double").alias("value_um"))
    return (
        F.when(klass == 4, out(False, "no_response", top_um))
        .when(klass.isNull() | ac50_um.isNull(), out(None, "no_fit", F.lit(None)))
        .when(F.coalesce(cytotoxic, F.lit(False)), out(None, "cytotoxic", ac50_um))
        .when(~strong, out(None, "weak", ac50_um))
        .when(ac50_um <= most_um, out(True, "active", ac50_um))
        .otherwise(out(None, "below_threshold", ac50_um))
    )


def collapse_replicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per key: the first (by ordinal), but active wins over inactive and sets ``disagree``."""
    g = rows.where("active is not null").groupBy(*keys).agg(F.bool_or("active").alias("active"), (F.bool_or("active") & F.bool_or(~F.col("active"))).alias("disagree"), F.min_by("value_um", F.struct((~F.col("active")).alias("o"), "ordinal")).alias("value_um"))
    return g.select(*keys, "active", "disagree", "value_um")


def sign_by_anchors(scores: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sign): the majority sign of the anchor genes' scores against what is expected of them; ties and no anchors give 0."""
    x = scores.join(anchors, "gene").groupBy(*by).agg(F.sum(F.signum("score") * F.col("expected")).alias("s"))
    return scores.select(*by).distinct().join(x, by, "left").select(*by, F.coalesce(F.signum("s"), F.lit(0.0)).cast("int").alias("sign"))


def gene_direction(score: Column, multiplier: Column) -> Column:
    s = F.signum(score.try_cast("double") * multiplier)
    return F.when(s > 0, F.lit("dependency")).when(s < 0, F.lit("restriction"))


# ---------------------------------------------------------------- interactions


def interaction_gate(a_viral: Column, b_viral: Column, a: Column, b: Column, method: Column, publication: Column, refused: list[str]) -> Column:
    """The first gate that an interaction row fails, null if it passes all."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit("identifier"))
        .when(a_viral == b_viral, F.lit("same_side"))
        .when(F.coalesce(F.lower(method), F.lit("")).isin(refused), F.lit("method"))
        .when(publication.isNull(), F.lit("publication"))
    )


def orient(rows: DataFrame) -> DataFrame:
    """rows with ``host`` and ``viral`` from the unordered pair (a, b, a_viral)."""
    return rows.withColumn("host", F.when(F.col("a_viral"), F.col("b")).otherwise(F.col("a"))).withColumn("viral", F.when(F.col("a_viral"), F.col("a")).otherwise(F.col("b")))


def first_of(rows: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """The first row of each key by ordinal; a partial aggregate of one struct, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ordinal)).alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------- indications, targets, folds


def collapse_indications(rows: DataFrame) -> DataFrame:
    """(compound, disease, phase, predicate, reference): TREATS from phase 4; a trial needs a registry id, the smallest is kept."""
    g = rows.groupBy("compound", "disease").agg(F.max("phase").alias("phase"), F.min("registry_id").alias("reference"))
    return g.withColumn("predicate", F.when(F.col("phase") >= 4, "TREATS").otherwise("IN_TRIAL_FOR")).where((F.col("phase") >= 4) | F.col("reference").isNotNull())


def collapse_targets(rows: DataFrame) -> DataFrame:
    """(compound, target, type): the first row's action, the earliest year, publications, and least, greatest and number of potencies."""
    return rows.groupBy("compound", "target", "type").agg(
        F.min_by("action", F.struct("ordinal", "action")).alias("action"), F.min("year").alias("year"), F.array_sort(F.collect_set("publication")).alias("publications"),
        F.min("nm").alias("potency_min_nm"), F.max("nm").alias("potency_max_nm"), F.count("nm").alias("potency_rows"),
    )


def unanimous(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the value where all rows of a key agree, else "unknown"."""
    return rows.groupBy(by).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise(F.lit("unknown")).alias(value))


FOLD_ROWS = 500  #: chains of a fold that one block pairs with the whole fold


def fold_pairs(chains: DataFrame) -> DataFrame:
    """(a, b, allowed, mode, strength, shared) of chain pairs that share a fold, gated by role and chemistry.

    chains: id, role, catalytic_type ("none": no machinery, "unknown": not established), folds. Pairs meet
    by fold, so chains without a common fold are never paired; gates apply in order. A pair is made in its
    first common fold only, with what both rows carry, so pairs leave as they are made and are never
    shuffled. A large fold is dealt in blocks to tasks of their own, by the number of its chains.
    """
    key, spark = ["id", "role", "catalytic_type"], chains.sparkSession
    own = chains.groupBy(*key).agg(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("folds"))))).alias("folds"))
    each = own.withColumn("fold", F.explode("folds"))
    blocks = each.groupBy("fold").agg(F.ceil(F.count("*") / FOLD_ROWS).cast("int").alias("blocks"))
    each = each.join(blocks, "fold")
    side = lambda df, s: df.select("fold", "block", *[F.col(c).alias(f"{n}_{s}") for c, n in zip([*key, "folds"], ("id", "role", "type", "folds"))])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number: few bytes here become many pairs, so no partitions are joined together
    a = side(each.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "a").repartition(n, "fold", "block")
    b = side(each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "b").repartition(n, "fold", "block")
    one = (F.size("folds_a") == 1) | (F.size("folds_b") == 1)
    shared = F.when(one, F.array("fold")).otherwise(F.array_intersect("folds_a", "folds_b"))
    x = a.join(b.hint("merge"), ["fold", "block"]).where((F.col("id_a") < F.col("id_b")) & (one | (F.get(shared, F.lit(0)) == F.col("fold"))))
    ta, tb = F.col("type_a"), F.col("type_b")
    mode = (
        F.when(F.col("role_a") != F.col("role_b"), "role_differs").when((ta == "unknown") | (tb == "unknown"), "unknown_chemistry")
        .when((ta == "none") != (tb == "none"), "one_sided").when((ta == "none") & (tb == "none"), "fold_only").when(ta == tb, "catalytic").otherwise("types_differ")
    )
    x = x.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), mode.alias("mode"), F.when(one, F.col("fold")).otherwise(F.array_join(shared, "|")).alias("shared"))
    return x.select("a", "b", F.col("mode").isin("fold_only", "catalytic").alias("allowed"), "mode", F.when(F.col("mode") == "catalytic", "strong").when(F.col("mode") == "fold_only", "weak").alias("strength"), "shared")


# ---------------------------------------------------------------- identifiers


def unique_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with exactly one value."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").select(key, value)


def resolve_compounds(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (row, key, external) with ``id`` and ``route``: the exact key, else the only node of its skeleton, else the only node of its external id."""
    exact = nodes.select(F.col("key").alias("_k"), F.col("id").alias("_e")).groupBy("_k").agg(F.min("_e").alias("_e"))
    skel = unique_map(nodes.select(scalar.skeleton(F.col("key")).alias("_s"), F.col("id").alias("_b")), "_s", "_b")
    ext = unique_map(nodes.select(F.col("external").alias("_x"), F.col("id").alias("_c")), "_x", "_c")
    w = wanted.withColumn("_sk", scalar.skeleton(F.col("key")))
    x = w.join(exact, w.key == exact._k, "left").join(skel, F.col("_sk") == F.col("_s"), "left").join(ext, F.col("external") == F.col("_x"), "left")
    route = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_b").isNotNull(), "skeleton").when(F.col("_c").isNotNull(), "external").otherwise("absent")
    return x.select(*wanted.columns, F.coalesce("_e", "_b", "_c").alias("id"), route.alias("route"))


def recover_accessions(wanted: DataFrame, primary: DataFrame, secondary: DataFrame, deleted: DataFrame) -> DataFrame:
    """wanted (accession) with ``status`` and ``id``: malformed, primary, secondary (one heir), demerged (several), deleted or unknown."""
    heirs = secondary.groupBy("accession").agg(F.count_distinct("primary").alias("_n"), F.min("primary").alias("_h"))
    p, d = primary.select("accession", F.lit(True).alias("_p")).distinct(), deleted.select("accession", F.lit(True).alias("_d")).distinct()
    x = wanted.join(p, "accession", "left").join(heirs, "accession", "left").join(d, "accession", "left")
    ok = F.col("accession").rlike(r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$")
    status = F.when(~ok, "malformed").when(F.col("_p"), "primary").when(F.col("_n") == 1, "secondary").when(F.col("_n") > 1, "demerged").when(F.col("_d"), "deleted").otherwise("unknown")
    return x.select(*wanted.columns, status.alias("status"), F.when(F.col("_p"), F.col("accession")).when(F.col("_n") == 1, F.col("_h")).alias("id"))


def resolve_symbols(wanted: DataFrame, genes: DataFrame) -> DataFrame:
    """wanted (symbol) with ``status`` (resolved, ambiguous, unresolved) and ``id``; case does not matter."""
    g = genes.groupBy(F.upper("symbol").alias("_u")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_i"))
    x = wanted.withColumn("_w", F.upper("symbol")).join(g, F.col("_w") == F.col("_u"), "left")
    status = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return x.select(*wanted.columns, status.alias("status"), F.when(F.col("_n") == 1, F.col("_i")).alias("id"))


def richest_first(chains: DataFrame) -> DataFrame:
    """(label, accession, chain): of entries that share a chain label the one with most chains owns it, ties to the smaller accession."""
    rows = chains.withColumn("_n", F.count("*").over(Window.partitionBy("accession")))
    return rows.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min_by(F.struct("accession", "chain"), F.struct((-F.col("_n")).alias("n"), "accession", "chain")).alias("_r")).select("label", "_r.accession", "_r.chain")
