"""Layers of witnesses assembled into one release of facts.

A fact's key is (subject, predicate, object), with the source and with identity qualifiers where the
predicate declares them. Commutative parts (support, sources, publications, tier, date, the qualifier
ladder) are plain aggregates with map-side partial sums; parts that depend on order (precedence
qualifiers and the potency range, which is repaired after every pairwise step) are folded over the
witnesses sorted by (layer rank, line).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Qualifier ladders, least specific first; the layers' precedence.
LADDERS = {"direction": ["unknown", "modulator"]}
LAYER_PRECEDENCE = ["spine", "host", "vhppi", "orcs", "curated", "chembl", "selectivity", "gtop", "hosttargets", "similarity", "ncats", "indications", "folds"]
CONTESTED = "contested"
PLACEHOLDER = "1970"


def layer_rank(layer: Column) -> Column:
    """The position in the precedence list; undeclared layers come after it."""
    at = F.array_position(F.array(*map(F.lit, LAYER_PRECEDENCE)), layer)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(LAYER_PRECEDENCE)))


def edge_key(source_in_key: Column | None = None, identity: list[str] | None = None) -> list[Column]:
    """The key columns of a fact."""
    keys = [F.col("subject"), F.col("predicate"), F.col("object")]
    if source_in_key is not None:
        keys.append(F.when(source_in_key, F.col("source")).alias("key_source"))
    return keys + [F.col(c).alias(f"key_{c}") for c in identity or []]


def fact_id(*parts: Column) -> Column:
    """A stable id derived from the key: "E" and 16 hex digits of a hash over the parts, nulls as empty."""
    return F.concat(F.lit("E"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def blake_fact_id(*parts: Column) -> Column:
    """The same shape of id by BLAKE2b with an 8-byte digest, for parity with releases made elsewhere; Arrow batches."""
    @F.pandas_udf("string")
    def digest(x: pd.Series) -> pd.Series:
        return x.map(lambda s: "E" + hashlib.blake2b(s.encode(), digest_size=8).hexdigest())

    return digest(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def earliest(date: Column) -> Column:
    """Aggregate: the least date that is no placeholder, else the least date; dates compare as text."""
    real = F.min(F.when(~date.startswith(PLACEHOLDER) & (date != ""), date))
    return F.coalesce(real, F.min(F.when(date != "", date)))


def ladder(value: Column, steps: list[str]) -> Column:
    """Aggregate: the most specific claim; two different claims at the top are contested."""
    at = F.array_position(F.array(*map(F.lit, steps)), value)
    rank = F.when(at > 0, at - 1).otherwise(F.lit(len(steps)))
    top = F.max(F.when(value.isNotNull(), rank))
    specific = F.collect_set(F.when(value.isNotNull() & (rank == len(steps)), value))
    graded = F.max_by(value, F.when(value.isNotNull(), rank))
    return F.when(top < len(steps), graded).when(F.size(specific) > 1, F.lit(CONTESTED)).otherwise(F.get(specific, F.lit(0)))


def first_present(value: Column, order: Column) -> Column:
    """Aggregate: the first value present in the witnesses' order; the smallest of those that share a place."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(order, value)))


def merged_sources(source: Column) -> Column:
    """Aggregate: the distinct parts of "|"-separated sources, sorted and joined."""
    parts = F.flatten(F.collect_set(F.split(F.coalesce(source, F.lit("")), r"\|")))
    return F.array_join(F.array_sort(F.filter(F.array_distinct(parts), lambda x: x != "")), "|")


def merge_edges(witnesses: DataFrame, keys: list[str], *, precedence: list[str] = (), ladders: dict[str, list[str]] | None = None, derived_absence: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per key: support_count, source, publications, evidence_tier, first_asserted_date, qualifiers.

    Witnesses have layer_rank, line_no, source, and where present publications, support_count,
    evidence_tier and first_asserted_date. ``derived_absence`` maps a flag to the qualifiers that must all
    be null; it is computed after the merge.
    """
    have, order = set(witnesses.columns), F.struct("layer_rank", "line_no")
    aggs = [F.sum(F.coalesce("support_count", F.lit(1)) if "support_count" in have else F.lit(1)).alias("support_count"), merged_sources(F.col("source")).alias("source")]
    if "evidence_tier" in have:
        aggs.append(F.min(F.coalesce("evidence_tier", F.lit(4))).alias("evidence_tier"))
    if "first_asserted_date" in have:
        aggs.append(earliest(F.col("first_asserted_date")).alias("first_asserted_date"))
    aggs += [first_present(F.col(c), order).alias(c) for c in precedence]
    aggs += [ladder(F.col(c), steps).alias(c) for c, steps in (ladders or {}).items()]
    out = witnesses.groupBy(*keys).agg(*aggs)
    if "publications" in have:  # distinct before they are gathered: repeats of a much-cited fact never meet in one row
        each = witnesses.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.explode("publications").alias("_pub")).distinct()
        cited = each.groupBy(*[f"_{i}" for i in range(len(keys))]).agg(F.array_sort(F.collect_set("_pub")).alias("publications"))
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
        out = out.join(cited, on, "left").select(*out.columns, F.coalesce("publications", F.array().cast("array<string>")).alias("publications"))
    for flag, needs in (derived_absence or {}).items():
        out = out.withColumn(flag, F.coalesce(*[F.col(c).cast("string") for c in needs]).isNull())
    return out


def fold_potency(witnesses: DataFrame, keys: list[str], field: str = "potency") -> DataFrame:
    """(keys..., field, low, high): potency and its range folded over ordered witnesses.

    A step takes each part from the earlier side where present; a range that does not hold the point is
    dropped at once, and a later witness may bring one again. Sorted arrays per fact, no Python.
    """
    w = witnesses.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layer_rank", "line_no", F.col(field).alias("x"), F.col("low").alias("lo"), F.col("high").alias("hi")))).alias("ws"))
    parts = F.transform("ws", lambda s: F.struct(s["x"].alias("x"), s["lo"].alias("lo"), s["hi"].alias("hi")))

    def step(acc: Column, nxt: Column) -> Column:
        x, lo, hi = F.coalesce(acc["x"], nxt["x"]), F.coalesce(acc["lo"], nxt["lo"]), F.coalesce(acc["hi"], nxt["hi"])
        ok = F.coalesce((lo <= x) & (x <= hi), F.lit(False))
        return F.struct(x.alias("x"), F.when(ok, lo).alias("lo"), F.when(ok, hi).alias("hi"))

    folded = F.aggregate(F.slice(parts, 2, 1_000_000_000), parts[0], step)
    return w.select(*keys, folded.alias("f")).select(*keys, F.col("f.x").alias(field), F.col("f.lo").alias("low"), F.col("f.hi").alias("high"))


def merge_nodes(rows: DataFrame, properties: list[str]) -> DataFrame:
    """(id, class, properties..., conflicts): the first class wins and other classes' rows are left out; nulls are filled in layer order, nothing is overwritten; ``conflicts`` counts properties with different values."""
    order = F.struct("layer_rank", "line_no")
    first = rows.groupBy("id").agg(F.min_by("class", F.struct(order, "class")).alias("class"))
    own = rows.join(first, ["id", "class"])
    conflict = [(F.count_distinct(p) > 1).cast("int") for p in properties]
    return own.groupBy("id", "class").agg(*[first_present(F.col(p), order).alias(p) for p in properties], sum(conflict[1:], conflict[0]).alias("conflicts"))


def assemble(layers: dict[str, tuple[DataFrame, DataFrame]], *, properties: list[str], precedence: list[str] = (), ladders: dict[str, list[str]] | None = None, derived_absence: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layers of (nodes, edges) as one release: (nodes, edges with edge_id, accounting).

    Layers rank by the declared precedence; lines within a layer by ``line_no``. A node keeps its first
    class, and rows of another class are left out and counted; properties fill gaps and never overwrite.
    The accounting has, for each layer, how many nodes and edges it brought and how many of them merged into
    an earlier layer's (``new`` + ``merged`` + ``rejected`` = ``rows``).
    """
    order = F.struct("layer_rank", "line_no")
    stack = lambda i: _union([df[i].withColumn("layer", F.lit(name)).withColumn("layer_rank", layer_rank(F.lit(name))) for name, df in layers.items()])
    nodes, edges = stack(0), stack(1)
    keys = ["subject", "predicate", "object"]
    first_n = nodes.groupBy("id").agg(F.min_by("class", F.struct(order, "class")).alias("_class"), F.min(order).alias("_first"))
    first_e = edges.groupBy(*keys).agg(F.min(order).alias("_first"))
    fate_n = nodes.join(first_n, "id").select("layer", F.lit("nodes").alias("kind"), F.when(F.col("class") != F.col("_class"), "rejected").when(order == F.col("_first"), "new").otherwise("merged").alias("fate"))
    fate_e = edges.join(first_e, keys).select("layer", F.lit("edges").alias("kind"), F.when(order == F.col("_first"), "new").otherwise("merged").alias("fate"))
    fates = fate_n.unionByName(fate_e).groupBy("layer", "kind").agg(F.count("*").alias("rows"), *[F.count_if(F.col("fate") == x).alias(x) for x in ("new", "merged", "rejected")])
    merged = merge_edges(edges, keys, precedence=list(precedence), ladders=ladders, derived_absence=derived_absence)
    return merge_nodes(nodes, properties), merged.withColumn("edge_id", fact_id(*[F.col(k) for k in keys])), fates


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def id_collisions(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(edge_id, keys): ids that more than one key has."""
    return facts.groupBy("edge_id").agg(F.count_distinct(*keys).alias("keys")).where("keys > 1")


def reconcile(accounting: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, counted, present) where the layers' new rows do not add up to what the release has."""
    present = nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("present")).unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("present")))
    counted = accounting.groupBy("kind").agg(F.sum("new").alias("counted"))
    return present.join(counted, "kind", "left").select("kind", F.coalesce("counted", F.lit(0)).cast("long").alias("counted"), "present").where("counted <> present")


def class_conflicts(rows: DataFrame) -> DataFrame:
    """(id, classes): node ids claimed by more than one class."""
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("classes"), F.count_distinct("class").alias("n")).where("n > 1").select("id", "classes")


def last_node(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    return rows.groupBy("id").agg(F.max_by(value, ordinal).alias(value))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b with ``change``: how many more copies b has than a; rows that are equally frequent are left out. One shuffle."""
    both = a.withColumn("d", F.lit(-1)).unionByName(b.withColumn("d", F.lit(1)))
    return both.groupBy(*a.columns).agg(F.sum("d").alias("change")).where(F.col("change") != 0)


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): a hash of the rows that does not depend on their order."""
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("sum")).select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.coalesce("sum", F.lit(0)).cast("string")), 256).alias("digest"))
