"""Studies over labels and scores: nulls, corrected intervals, populations, coverage and reach."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans import metapath
from ..sources.graph_view import Graph
from . import graph as g_ops


def degree_null(g: Graph, held_out: list[str], cls: str) -> DataFrame:
    """(id, score): the degree over edges that are not held out, zero where there is none; refuses when nothing is held out."""
    deg = g_ops.degree_without(g.edges, held_out)
    return g.nodes.where(F.col("class") == cls).select("id").join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("double").alias("score"))


def study_degree(edges: DataFrame, predicate: str, outside: DataFrame) -> DataFrame:
    """(id, degree): edges of the predicate of which no end is ``outside`` (id), counted at both ends."""
    own = edges.where(F.col("predicate") == predicate)
    for end in ("subject", "object"):
        own = own.join(outside.select(F.col("id").alias(end)), end, "left_anti")
    return g_ops.degree(own)


def partners(edges: DataFrame, predicate: str, of: DataFrame, degree: DataFrame, hub_cut: int | None, outside: DataFrame) -> DataFrame:
    """(id, hub): nodes joined to any of ``of`` by the predicate, either way, without those ``outside``; those over the cut are marked, not dropped."""
    e = edges.where(F.col("predicate") == predicate)
    mine = of.select(F.col("id").alias("x"))
    near = e.join(mine, e.subject == mine.x).select(F.col("object").alias("id")).unionByName(e.join(mine, e.object == mine.x).select(F.col("subject").alias("id"))).distinct()
    near = near.join(outside.select("id"), "id", "left_anti").join(degree, "id", "left")
    return near.select("id", (F.coalesce("degree", F.lit(0)) > hub_cut if hub_cut else F.lit(False)).alias("hub"))


def share_by_method(edges: DataFrame, by: list[str], method: Column, binary: list[str]) -> DataFrame:
    """(by..., binary, total, share) of edges whose method is a binary one."""
    out = edges.groupBy(*by).agg(F.count_if(F.coalesce(method.isin(*binary), F.lit(False))).alias("binary"), F.count("*").alias("total"))
    return out.withColumn("share", F.col("binary") / F.col("total"))


def corrected(metrics: DataFrame, z: float) -> DataFrame:
    """AUC rows (n_pos, n_neg, auc, coverage_pos, coverage_neg) with the interval at a corrected level, its verdict and direction.

    A cell in which a class has no coverage was not measured: its AUC and bounds are null and ``refusal`` says why.
    """
    measured = F.coalesce((F.col("coverage_pos") > 0) & (F.col("coverage_neg") > 0), F.lit(False))
    bounds = stats.hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg"), z)
    low, high = bounds["low"], bounds["high"]
    only = lambda c: F.when(measured, c)
    return metrics.select(
        *[c for c in metrics.columns if c != "auc"],
        only(F.col("auc")).alias("auc"), measured.alias("measurable"), only(low).alias("low"), only(high).alias("high"), only((low > 0.5) | (high < 0.5)).alias("clears"),
        only(F.when(F.col("auc") > 0.5, "above").when(F.col("auc") < 0.5, "below").otherwise("at")).alias("direction"), F.when(~measured, "nothing was scored in this cell").alias("refusal"),
    )


def label_cell(labels: DataFrame, clinical: DataFrame, by: list[str], least_positives: int, least_negatives: int) -> DataFrame:
    """(by..., positives, negatives, refusal): the assayed population of labels(by..., id), positive where ``clinical`` (by..., id) has it too."""
    has = clinical.select(*by, "id").distinct().withColumn("_in", F.lit(True))
    cell = labels.select(*by, "id").distinct().join(has, [*by, "id"], "left").groupBy(*by).agg(F.count("_in").alias("positives"), F.count_if(F.col("_in").isNull()).alias("negatives"))
    few = F.concat_ws("; ", F.when(F.col("positives") < least_positives, F.concat(F.col("positives"), F.lit(f" positives, fewer than {least_positives}"))), F.when(F.col("negatives") < least_negatives, F.concat(F.col("negatives"), F.lit(f" negatives, fewer than {least_negatives}"))))
    return cell.withColumn("refusal", F.nullif(few, F.lit("")))


def reference_population(candidates: DataFrame, references: DataFrame, publications: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, reference): the references a candidate may be scored against: not itself, and none that shares a publication with it.

    Shared publications are joined on the publication, so no pair is made that shares nothing; the pairs themselves
    are the population that is asked for.
    """
    pairs = candidates.select(*by, "id").join(references.select(*by, F.col("id").alias("reference")), by).where("id <> reference")
    a, b = publications.select("id", "publication"), publications.select(F.col("id").alias("reference"), "publication")
    shared = a.join(b, "publication").where("id <> reference").select("id", "reference").distinct()
    return pairs.join(shared, ["id", "reference"], "left_anti")


def population_sizes(candidates: DataFrame, references: DataFrame, publications: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, n): how many references ``reference_population`` has for a candidate, where it has any; the pairs are not made.

    The references of a cell, less the candidate itself and less those that share a publication with it. Only those
    are found one by one: publications are joined together with the cell.
    """
    c, f = candidates.select(*by, "id").distinct(), references.select(*by, F.col("id").alias("reference")).distinct()
    own = f.select(*by, F.col("reference").alias("id"), F.lit(1).alias("_own"))
    p = publications.select("id", "publication")
    shared = p.join(c, "id").join(p.withColumnRenamed("id", "reference").join(f, "reference"), ["publication", *by]).where("id <> reference")
    shared = shared.select(*by, "id", "reference").distinct().groupBy(*by, "id").agg(F.count("*").alias("_shared"))
    n = F.col("_all") - F.coalesce("_own", F.lit(0)) - F.coalesce("_shared", F.lit(0))
    out = c.where("id is not null").join(f.where("reference is not null").groupBy(*by).agg(F.count("*").alias("_all")), by).join(own, [*by, "id"], "left").join(shared, [*by, "id"], "left")
    return out.select(*by, "id", n.alias("n")).where("n > 0")


def emptied_candidates(candidates: DataFrame, population: DataFrame, by: list[str]) -> DataFrame:
    """(by..., candidates, emptied): how many candidates an exclusion left without any reference; ``population`` may be its pairs or its sizes."""
    left = population.select(*by, "id").distinct().withColumn("_has", F.lit(True))
    return candidates.select(*by, "id").distinct().join(left, [*by, "id"], "left").groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(F.col("_has").isNull()).alias("emptied"))


def usable_comparator(reached: DataFrame, by: list[str], least: float = 0.2) -> DataFrame:
    """(by..., reach, usable): a comparator counts where it reaches that share of the labelled pairs."""
    out = reached.groupBy(*by).agg(F.avg(F.col("reached").cast("int")).alias("reach"))
    return out.withColumn("usable", F.col("reach") >= least)


def attribution(aucs: DataFrame) -> DataFrame:
    """AUC rows (full, degree, structure) with excesses over chance, their ratios and the cost of the control."""
    over = lambda c: F.col(c) - 0.5
    share = lambda c: F.when(over("full") != 0, over(c) / over("full"))
    return aucs.select("*", over("full").alias("excess"), share("degree").alias("degree_share"), share("structure").alias("structure_share"), (F.col("full") - F.col("structure")).alias("control_cost"))


def degree_weighting(full: DataFrame, unlabelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., full, unlabelled, change): scores of the same walk under both degrees; a pair that one lacks has zero there."""
    a, b = full.select(*keys, F.col("score").alias("full")), unlabelled.select(*keys, F.col("score").alias("unlabelled"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("full", F.lit(0.0)).alias("full"), F.coalesce("unlabelled", F.lit(0.0)).alias("unlabelled"), (F.coalesce("unlabelled", F.lit(0.0)) - F.coalesce("full", F.lit(0.0))).alias("change"))


def fold_edges(pairs: DataFrame, allowed: Column) -> DataFrame:
    """(a, b, fold): evaluated pairs that are allowed, ends in order, each once."""
    return pairs.where(allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "fold").distinct()


def direct_edges(edges: DataFrame, predicate: str, encoded: str, owner: str, node: str) -> DataFrame:
    """(subject, object): edges of the predicate whose object is encoded by what ``node`` owns; three equality joins."""
    owned = edges.where((F.col("predicate") == owner) & (F.col("object") == node)).select(F.col("subject").alias("mid"))
    targets = edges.where(F.col("predicate") == encoded).select(F.col("subject").alias("mid"), F.col("object").alias("object")).join(owned, "mid", "left_semi").select("object").distinct()
    return edges.where(F.col("predicate") == predicate).select("subject", "object").join(targets, "object", "left_semi")


def not_annotated(nodes: DataFrame, annotated: DataFrame) -> DataFrame:
    return nodes.join(annotated.select("id"), "id", "left_anti")


def annotated_digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest): a digest of the distinct subjects that depends neither on order nor on repeats; sums, no list."""
    h = rows.select("id").distinct().select(F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return h.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")), 256).alias("digest"))


def selectivity_filter(labels: DataFrame, si: DataFrame, least: float | None, sides: str) -> DataFrame:
    """Labels of compounds with a selectivity index (of at least ``least``), on "positives" only or on "both" sides."""
    ok = si.where(F.col("si") >= least) if least is not None else si.where("si is not null")
    kept = labels.join(ok.select("id", "virus").distinct(), ["id", "virus"], "left_semi")
    return kept if sides == "both" else kept.where("positive").unionByName(labels.where("not positive"))


def si_lookup(rows: DataFrame) -> DataFrame:
    """(id, virus, si): the last row's index by ordinal."""
    return rows.groupBy("id", "virus").agg(F.max_by("si", "ordinal").alias("si"))


def label_cells(labels: DataFrame) -> DataFrame:
    """(source, virus, positives, negatives, both): distinct compounds by side; of both where sources disagree."""
    one = labels.groupBy("source", "virus", "id").agg(F.bool_or("positive").alias("p"), F.bool_or(~F.col("positive")).alias("n"))
    return one.groupBy("source", "virus").agg(F.count_if("p").alias("positives"), F.count_if("n").alias("negatives"), F.count_if(F.col("p") & F.col("n")).alias("both"))


def screened_against(edges: DataFrame, predicates: list[str], node: str) -> DataFrame:
    """(id): what the predicates link to the node, from either side."""
    own = edges.where(F.col("predicate").isin(*predicates))
    return own.where(F.col("object") == node).select(F.col("subject").alias("id")).unionByName(own.where(F.col("subject") == node).select(F.col("object").alias("id"))).distinct()


def potency_census(edges: DataFrame, value: Column, relation: Column) -> DataFrame:
    """(kind, n): exact, censored or no potency."""
    return edges.groupBy(F.when(value.isNull(), "none").when(F.coalesce(relation, F.lit("=")).isin("=", "~"), "exact").otherwise("censored").alias("kind")).agg(F.count("*").alias("n"))


def skeleton_redundancy(rows: DataFrame, skeleton: Column) -> DataFrame:
    """(copies, skeletons, rows): how many skeletons have so many rows."""
    per = rows.groupBy(skeleton.alias("k")).agg(F.count("*").alias("copies"))
    return per.groupBy("copies").agg(F.count("*").alias("skeletons"), F.sum("copies").alias("rows"))


def reach_settings(g: Graph, path, degree: DataFrame, hubs: DataFrame, oversized: DataFrame) -> DataFrame:
    """(setting, starts, ends, pairs, paths): the reach of a metapath as it is, without hubs, without oversized nodes, and without either."""
    none = hubs.where(F.lit(False)).select("id")
    blocked = {"as_is": none, "hubs_off": hubs.select("id"), "cap_off": oversized.select("id"), "both_off": hubs.select("id").unionByName(oversized.select("id")).distinct()}
    out = None
    for name, ids in blocked.items():
        one = metapath.reach(metapath.walk(g, path, degree, blocked=ids)).select(F.lit(name).alias("setting"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def file_coverage(rows: DataFrame, by: list[str], eligible: Column, key: list[str], ordinal: list[str]) -> DataFrame:
    """(by..., rows, eligible, edges, duplicates): of eligible rows with one key over all files, the first by ordinal is the edge."""
    ok = F.coalesce(eligible, F.lit(False))
    first = rows.where(ok).groupBy(*key).agg(F.min(F.struct(*ordinal, *by)).alias("_f"))
    edges = first.groupBy(*[F.col(f"_f.{c}").alias(c) for c in by]).agg(F.count("*").alias("edges"))
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(ok).alias("eligible")).join(edges, by, "left")
    return out.select(*by, "rows", "eligible", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), (F.col("eligible") - F.coalesce("edges", F.lit(0))).alias("duplicates"))


def target_index(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxon, family, id): the last node (by ordinal) of each family of a species; taxa(any_taxon, taxon) says which isolate belongs to which."""
    own = nodes.where("family is not null").join(taxa.withColumnRenamed("taxon", "species"), F.col("taxon_id") == F.col("any_taxon"))
    return own.groupBy(F.col("species").alias("taxon"), "family").agg(F.max_by("id", "ordinal").alias("id"))


def known_keys(layers: list[DataFrame], cls: str, key: str) -> DataFrame:
    """(key): the distinct keys that nodes of a class have in earlier layers."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.where((F.col("class") == cls) & F.col(key).isNotNull()).select(key).distinct()


def name_index(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): lower-case names that one node has; a name of several nodes is left out."""
    n = names.join(nodes.select("id"), "id", "left_semi").select(F.lower(F.trim("name")).alias("name"), "id").where("name <> ''")
    return n.groupBy("name").agg(F.count_distinct("id").alias("c"), F.min("id").alias("id")).where("c = 1").select("name", "id")


def family_survey(organisms: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """organisms(family, taxon) counted, with how many rows each table(taxon) has for the family; absent is zero."""
    out = organisms.groupBy("family").agg(F.count_distinct("taxon").alias("organisms"))
    for name, t in tables.items():
        n = t.groupBy("taxon").agg(F.count("*").alias("_n")).join(organisms.select("family", "taxon").distinct(), "taxon").groupBy("family").agg(F.sum("_n").alias(name))
        out = out.join(n, "family", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def detectable_auc(n_pos: int, n_neg: int, z: float) -> float:
    """The least AUC whose interval's lower bound clears one half, by bisection."""
    low, high = 0.5, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        q1, q2 = mid / (2 - mid), 2 * mid * mid / (1 + mid)
        variance = (mid * (1 - mid) + (n_pos - 1) * (q1 - mid * mid) + (n_neg - 1) * (q2 - mid * mid)) / (n_pos * n_neg)
        if mid - z * math.sqrt(max(variance, 0.0)) > 0.5:
            high = mid
        else:
            low = mid
    return high
