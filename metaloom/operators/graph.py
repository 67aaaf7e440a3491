"""Degrees, hub cuts, censuses, neighbourhoods, alias chains and breadth-first distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..sources.graph_view import Graph


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): incident edges, each edge once for either end. Partial sums are made before the shuffle."""
    return edges.select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_without(edges: DataFrame, held_out: list[str]) -> DataFrame:
    """The degree over edges that are not held out; refuses when that skips nothing."""
    if not held_out:
        raise ValueError("no predicate is held out: this would be the plain degree under another name")
    if edges.where(F.col("predicate").isin(held_out)).isEmpty():
        raise ValueError(f"no edge has a held-out predicate of {held_out}")
    return degree(edges.where(~F.col("predicate").isin(held_out)))


def predicate_degree(edges: DataFrame) -> DataFrame:
    """(predicate, id, degree): in plus out."""
    return edges.select("predicate", F.explode(F.array("subject", "object")).alias("id")).groupBy("predicate", "id").agg(F.count("*").alias("degree"))


def nearest_rank(values: DataFrame, col: str, percentile: float) -> DataFrame:
    """One row (cut): the sorted value at index min(int(n * p / 100), n - 1), no interpolation.

    Values are counted first, so the ordered window runs over distinct values, not rows.
    """
    counts = values.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.least(F.floor(F.col("n") * F.lit(percentile) / 100), F.col("n") - 1)
    return upto.join(F.broadcast(total)).where(F.col("upto") > at).agg(F.min("v").alias("cut"))


def nearest_ranks(values: DataFrame, col: str, percentiles: dict[str, float]) -> DataFrame:
    """(name, cut): several nearest ranks from one pass over the value counts."""
    counts = values.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v")  # over distinct values
    x = counts.select("v", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p) / 100), F.col("n") - 1)
    cuts = x.agg(*[F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(name) for name, p in percentiles.items()])
    return cuts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("cut")) for n in percentiles])).alias("x")).select("x.*").where("cut is not null")


def hubs(nodes: DataFrame, degrees: DataFrame, classes: list[str], cut: int) -> DataFrame:
    """(id, degree) of nodes of the classes whose degree is over the cut."""
    return nodes.where(F.col("class").isin(classes)).join(degrees.where(F.col("degree") > cut), "id").select("id", "degree")


def oversized(edges: DataFrame, predicate: str, cap: int | None) -> DataFrame:
    """(id, members) of objects of a predicate with more subjects than the cap; no cap, none."""
    out = edges.where(F.col("predicate") == predicate).groupBy(F.col("object").alias("id")).agg(F.count("*").alias("members"))
    return out.where(F.col("members") > cap) if cap else out.where(F.lit(False))


def class_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("class").agg(F.count("*").alias("n"))


def triple_counts(g: Graph) -> DataFrame:
    """(subject_class, predicate, object_class, n)."""
    s, o = g.nodes.select(F.col("id").alias("subject"), F.col("class").alias("subject_class")), g.nodes.select(F.col("id").alias("object"), F.col("class").alias("object_class"))
    return g.edges.join(s, "subject").join(o, "object").groupBy("subject_class", "predicate", "object_class").agg(F.count("*").alias("n"))


def dangling(g: Graph) -> DataFrame:
    """(subject, predicate, object, missing): edges with an end that is no node."""
    ids = g.nodes.select("id")
    s = g.edges.join(ids, g.edges.subject == ids.id, "left_anti").select("subject", "predicate", "object", F.lit("subject").alias("missing"))
    o = g.edges.join(ids, g.edges.object == ids.id, "left_anti").select("subject", "predicate", "object", F.lit("object").alias("missing"))
    return s.unionByName(o)


def orphans(g: Graph) -> DataFrame:
    """Nodes that no edge touches."""
    touched = g.edges.select(F.explode(F.array("subject", "object")).alias("id"))
    return g.nodes.join(touched, "id", "left_anti")


def neighbourhood(edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """Edges at a node in (predicate, subject, object) order, with the number that exist; two equality scans."""
    own = edges.where(F.col("subject") == node).unionByName(edges.where((F.col("object") == node) & (F.col("subject") != node)))
    total = own.agg(F.count("*").alias("total"))  # one row
    return own.join(F.broadcast(total)).orderBy("predicate", "subject", "object", "qualifier", "year").limit(limit)


def profile(g: Graph, node: str) -> DataFrame:
    """(direction, predicate, class, neighbours, edges) of one node."""
    out = g.edges.where(F.col("subject") == node).select(F.lit("out").alias("direction"), "predicate", F.col("object").alias("id"))
    into = g.edges.where(F.col("object") == node).select(F.lit("in").alias("direction"), "predicate", F.col("subject").alias("id"))
    return out.unionByName(into).join(g.nodes, "id").groupBy("direction", "predicate", "class").agg(F.countDistinct("id").alias("neighbours"), F.count("*").alias("edges"))


def resolve_aliases(ids: DataFrame, aliases: DataFrame, nodes: DataFrame, hops: int = 8) -> DataFrame:
    """(id, resolved): aliases followed up to ``hops`` steps; a cycle or an end that is no node gives null.

    ``aliases`` is (subject, object, ordinal); of a subject's aliases the last counts. Cycles are found by
    keeping the ids visited, at most ``hops`` of them.
    """
    last = aliases.groupBy(F.col("subject").alias("s")).agg(F.max_by("object", "ordinal").alias("o"))
    now = ids.select("id", F.col("id").alias("cur"), F.array("id").alias("seen"), F.lit(False).alias("cycle"))
    for _ in range(hops):
        nxt = now.join(last, now.cur == last.s, "left")
        again = F.coalesce(F.array_contains("seen", F.col("o")), F.lit(False))
        go = F.col("o").isNotNull() & ~F.col("cycle") & ~again
        now = nxt.select("id", F.when(go, F.col("o")).otherwise(F.col("cur")).alias("cur"), F.when(go, F.array_append("seen", F.col("o"))).otherwise(F.col("seen")).alias("seen"), (F.col("cycle") | again).alias("cycle"))
    known = nodes.select(F.col("id").alias("node"))
    return now.join(known, now.cur == known.node, "left").select("id", F.when(~F.col("cycle"), F.col("node")).alias("resolved"))


def distances(edges: DataFrame, starts: DataFrame, hops: int = 4, blocked: DataFrame | None = None) -> DataFrame:
    """(id, distance): hops from the nearest start over undirected edges (a, b); blocked nodes are neither entered nor left.

    Links and each hop's front are written, so that a hop reads the last front, not the plan that led to it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    if blocked is not None:
        both = both.join(blocked.select(F.col("id").alias("b")), "b", "left_anti")
    both = written(both)
    seen = front = written(starts.select("id").distinct().withColumn("distance", F.lit(0)))
    for h in range(1, hops + 1):
        front = written(both.join(front, both.a == front.id).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(h)))
        seen = seen.unionByName(front)
    return seen
