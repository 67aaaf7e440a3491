"""Metapaths compiled to join plans.

A metapath is [Class, PREDICATE, Class, ...]; "<PREDICATE" walks an edge from object to subject, symmetric
predicates are walked both ways. The compiled plan aggregates after every hop: of a path only the start,
the node it has come to and the earlier nodes that a later hop could meet again (same class: paths are
simple) are kept, so rows with the same key are summed before the next join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..sources.graph_view import Graph


@dataclass(frozen=True)
class Hop:
    predicate: str
    reverse: bool
    target: str


@dataclass(frozen=True)
class Metapath:
    """``constraints`` maps a predicate to the value its qualifier must have; an absent qualifier never matches."""

    name: str
    start: str
    hops: tuple[Hop, ...]
    constraints: dict[str, str] = field(default_factory=dict)
    exclude_hubs: bool = False


def parse(name: str, path: list[str], constraints: dict[str, str] | None = None, exclude_hubs: bool = False) -> Metapath:
    if len(path) < 3 or len(path) % 2 == 0:
        raise ValueError(f"{name}: a metapath alternates classes and predicates")
    hops = tuple(Hop(p.removeprefix("<"), p.startswith("<"), c) for p, c in zip(path[1::2], path[2::2]))
    return Metapath(name, path[0], hops, constraints or {}, exclude_hubs)


def problems(path: Metapath, triples: set[tuple[str, str, str]], symmetric: frozenset[str], declared: set[str]) -> list[str]:
    """What is wrong with a metapath against the declared triples: unknown predicates, undeclared symmetry, needless reverses, broken hops."""
    out, at = [], path.start
    for h in path.hops:
        if h.predicate not in declared:
            out.append(f"unknown predicate {h.predicate}")
        elif h.predicate in symmetric and h.reverse:
            out.append(f"needless reverse of symmetric {h.predicate}")
        elif not any((s, p, o) in triples for s, p, o in [(h.target, h.predicate, at) if h.reverse else (at, h.predicate, h.target)] + [(h.target, h.predicate, at)] * (h.predicate in symmetric)):
            out.append(f"{h.predicate} does not lead from {at} to {h.target}")
        at = h.target
    return out


def hop_relation(g: Graph, hop: Hop, constraint: str | None = None) -> DataFrame:
    """(src, dst) of one hop: a bag, so parallel edges are separate steps; both directions of a symmetric predicate."""
    e = g.edges.where(F.col("predicate") == hop.predicate)
    if constraint is not None:
        e = e.where(F.col("qualifier") == constraint)
    forth = e.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    back = e.select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    if hop.predicate in g.symmetric:
        return forth.unionByName(back)
    return back if hop.reverse else forth


def walk(g: Graph, path: Metapath, degree: DataFrame, *, exponent: float = -0.4, blocked: DataFrame | None = None, starts: DataFrame | None = None, scheme: str = "node") -> DataFrame:
    """(start, end, score, paths): the sum over simple paths of the product of step weights.

    "node": degree ** exponent of every node entered (absent or zero: 1). "edge": (out-degree of the step's
    source x in-degree of its target, by predicate) ** exponent. ``blocked`` nodes (id) are no inner nodes;
    the last hop and the start are free of it. Degrees are written once, not planned again at every hop.
    """
    if scheme == "node":
        degree = written(degree.select("id", "degree"))
    node = g.nodes
    state = node.where(F.col("class") == path.start).select(F.col("id").alias("start"), F.col("id").alias("cur"))
    if starts is not None:
        state = state.join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    state = state.withColumn("w", F.lit(1.0)).withColumn("n", F.lit(1).cast("long"))
    classes = [path.start, *(h.target for h in path.hops)]
    kept: list[int] = [0]  # positions whose node a later hop must not meet again; "start" is position 0
    for i, hop in enumerate(path.hops, 1):
        rel = hop_relation(g, hop, path.constraints.get(hop.predicate))
        target = node.where(F.col("class") == hop.target).select("id")
        target = target.join(degree, "id", "left") if scheme == "node" else target
        if blocked is not None and i < len(path.hops):
            target = target.join(blocked.select("id"), "id", "left_anti")
        if scheme == "edge":
            outs, ins = rel.groupBy("src").agg(F.count("*").alias("do")), rel.groupBy("dst").agg(F.count("*").alias("di"))
            step = rel.join(outs, "src").join(ins, "dst").join(target.select(F.col("id").alias("dst")), "dst", "left_semi")
            step = step.select("src", "dst", F.pow(F.col("do") * F.col("di"), F.lit(exponent)).alias("sw"))
        else:
            weight = F.when(F.coalesce("degree", F.lit(0)) > 0, F.pow("degree", F.lit(exponent))).otherwise(F.lit(1.0))
            step = rel.join(target.select(F.col("id").alias("dst"), weight.alias("sw")), "dst")
        step = step.groupBy("src", "dst", "sw").agg(F.count("*").alias("m"))
        names = {0: "start"} | {k: f"p{k}" for k in kept if k}
        joined = state.join(step, state.cur == step.src)
        for k in kept:
            if classes[k] == hop.target:
                joined = joined.where(F.col(names[k]) != F.col("dst"))
        if classes[i - 1] == hop.target and i - 1 not in kept:
            joined = joined.where(F.col("cur") != F.col("dst"))
        later = set(classes[i + 1 :])
        if i - 1 and classes[i - 1] in later | {hop.target} and i - 1 not in kept and classes[i - 1] in later:
            joined, kept = joined.withColumn(f"p{i - 1}", F.col("cur")), [*kept, i - 1]
        kept = [k for k in kept if k == 0 or classes[k] in later]
        keys = ["start", *(f"p{k}" for k in kept if k), "dst"]
        state = joined.groupBy(*keys).agg(F.sum(F.col("w") * F.col("sw") * F.col("m")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("n")).withColumnRenamed("dst", "cur")
    return state.groupBy("start", F.col("cur").alias("end")).agg(F.sum("w").alias("score"), F.sum("n").alias("paths"))


def reach(walked: DataFrame) -> DataFrame:
    """One row: starts that reach anything, distinct ends, pairs and paths."""
    return walked.agg(F.countDistinct("start").alias("starts"), F.countDistinct("end").alias("ends"), F.count("*").alias("pairs"), F.coalesce(F.sum("paths"), F.lit(0)).cast("long").alias("paths"))


def missing_predicates(g: Graph, paths: list[Metapath]) -> DataFrame:
    """(metapath, missing): the predicates a metapath needs and no edge has, one row per metapath, null-free."""
    needs = g.edges.sparkSession.createDataFrame([(p.name, sorted({h.predicate for h in p.hops})) for p in paths], "metapath string, needs array<string>")
    have = g.edges.select("predicate").distinct()
    each = needs.select("metapath", F.explode("needs").alias("predicate"))
    gone = each.join(have, "predicate", "left_anti").groupBy("metapath").agg(F.array_join(F.sort_array(F.collect_list("predicate")), "|").alias("missing"))
    return needs.select("metapath").join(gone, "metapath", "left").select("metapath", F.coalesce("missing", F.lit("")).alias("missing"))
