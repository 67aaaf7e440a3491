"""Connected components of a link table by parent hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(a long, b long) to (v, p): each linked vertex with the smallest vertex of its component.

    Every round takes the least parent among a vertex's neighbours, hands it to the vertex and to its
    parent, and then jumps to the parent's parent; rounds are written to the shared folder. Joins are
    between written tables, so that adaptive execution can split a parent with many children.
    """
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").dropDuplicates()
    both = scratch.save(both)
    now = scratch.save(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")))
    total = None
    while (new := now.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]) != total:
        total = new
        near = scratch.save(both.join(now, both.b == now.v).groupBy("a").agg(F.min("p").alias("m")))
        least = now.join(near, now.v == near.a).select("v", "p", F.least("p", "m").alias("m"))
        hooked = scratch.save(least.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("p").alias("v"), "m"))).alias("x")).groupBy("x.v").agg(F.min("x.m").alias("p")))
        child, parent = hooked.alias("c"), hooked.select(F.col("v").alias("pv"), F.col("p").alias("pp"))
        jumped = scratch.save(child.join(parent, F.col("p") == F.col("pv")).select("v", F.col("pp").alias("p")))
        scratch.drop(now, near, hooked)
        now = jumped
    scratch.drop(both)
    return now
