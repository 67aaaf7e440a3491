"""Validation as violation rows, with checks generated from a declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import curie, is_date_or_year


@dataclass(frozen=True)
class Property:
    kind: str = "string"
    required: bool = False
    values: tuple = ()
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class NodeClass:
    name: str
    prefixes: tuple[str, ...]
    properties: dict[str, Property] = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeClass:
    subject: str
    predicate: str
    object: str
    symmetric: bool = False
    held_out: bool = False
    required: tuple[str, ...] = ()


def value_checks(col: Column, name: str, p: Property) -> list[Column]:
    """Columns that hold "CODE:name" where a value breaks its declaration."""
    code = lambda c: F.lit(f"{c}:{name}")
    out = []
    if p.required:
        out.append(F.when(col.isNull(), code("MISSING_PROPERTY")))
    if p.values:
        out.append(F.when(col.isNotNull() & ~col.isin(*p.values), code("ENUM")))
    if p.least is not None:
        out.append(F.when(col < p.least, code("RANGE")))
    if p.most is not None:
        out.append(F.when(col > p.most, code("RANGE")))
    if p.kind == "date":
        out.append(F.when(col.isNotNull() & ~is_date_or_year(col), code("TYPE")))
    return out


def _rows(df: DataFrame, key: list[str], checks: list[Column]) -> DataFrame:
    if not checks:
        return df.select(*key, F.lit("").alias("violation")).where(F.lit(False))
    return df.select(*key, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def validate_nodes(nodes: DataFrame, classes: list[NodeClass]) -> DataFrame:
    """(id, violation): unknown class, malformed or forbidden prefix, property checks, duplicates. One pass and one window."""
    known = F.col("class").isin([c.name for c in classes])
    prefix = curie(F.col("id"))["prefix"]
    checks = [F.when(~known, F.lit("UNKNOWN_NODE_CLASS")), F.when(known & prefix.isNull(), F.lit("CURIE"))]
    for c in classes:
        own = F.col("class") == c.name
        checks.append(F.when(own & prefix.isNotNull() & ~prefix.isin(*c.prefixes), F.lit("PREFIX")))
        for name, p in c.properties.items():
            if name in nodes.columns:
                checks += [F.when(own, x) for x in value_checks(F.col(name), name, p)]
            elif p.required:
                checks.append(F.when(own, F.lit(f"MISSING_PROPERTY:{name}")))
    copies = F.count("*").over(Window.partitionBy("id"))
    dup = nodes.withColumn("_copies", copies)
    return _rows(dup, ["id"], [*checks, F.when(F.col("_copies") > 1, F.lit("DUPLICATE_NODE"))])


def validate_edges(edges: DataFrame, nodes: DataFrame, classes: list[EdgeClass]) -> DataFrame:
    """(subject, predicate, object, violation). An unknown predicate, a dangling end or an undeclared triple ends an edge's checks."""
    ids = nodes.groupBy("id").agg(F.max("class").alias("class"))
    s, o = ids.select(F.col("id").alias("subject"), F.col("class").alias("_s")), ids.select(F.col("id").alias("object"), F.col("class").alias("_o"))
    x = edges.join(s, "subject", "left").join(o, "object", "left")
    known = F.col("predicate").isin(sorted({c.predicate for c in classes}))
    declared = F.lit(False)
    for c in classes:
        fits = lambda a, b: ((F.lit(c.subject == "any")) | (F.col(a) == c.subject)) & ((F.lit(c.object == "any")) | (F.col(b) == c.object))  # noqa: B023, E731
        ok = fits("_s", "_o") | (fits("_o", "_s") if c.symmetric else F.lit(False))
        declared = declared | ((F.col("predicate") == c.predicate) & ok)
    first = F.when(~known, F.lit("UNKNOWN_PREDICATE")).when(F.col("_s").isNull() | F.col("_o").isNull(), F.lit("DANGLING")).when(~declared, F.lit("UNDECLARED_TRIPLE"))
    symmetric = [c.predicate for c in classes if c.symmetric]
    later = [F.when(F.col("predicate").isin(symmetric) & (F.col("subject") == F.col("object")), F.lit("SYMMETRIC_SELF_LOOP")), F.when(F.col("source").isNull() | (F.col("source") == ""), F.lit("MISSING_PROVENANCE"))]
    later += [F.when((F.col("predicate") == c.predicate) & F.col("qualifier").isNull(), F.lit(f"MISSING_QUALIFIER:{q}")) for c in classes for q in c.required if q == "qualifier"]
    return _rows(x.withColumn("_first", first), ["subject", "predicate", "object"], [F.col("_first"), *[F.when(F.col("_first").isNull(), c) for c in later]])


def report(violations: DataFrame) -> DataFrame:
    """(code, n)."""
    return violations.groupBy(F.substring_index("violation", ":", 1).alias("code")).agg(F.count("*").alias("n"))


def gate_census(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """(gate, n): rows by the first gate that rejects them, "kept" where none does; the counts sum to the scan."""
    first = F.lit("kept")
    for name, passes in reversed(gates):
        first = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(first)
    return rows.groupBy(first.alias("gate")).agg(F.count("*").alias("n"))


def unexpected(violations: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(code, n, expected) where the counts differ from those planted."""
    want = violations.sparkSession.createDataFrame(list(expected.items()), "code string, expected long")
    return report(violations).join(want, "code", "full").where(~F.col("n").eqNullSafe(F.col("expected")))
