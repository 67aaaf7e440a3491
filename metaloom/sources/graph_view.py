"""The star schema seen as a typed graph: nodes(id, class) and edges(subject, predicate, object, qualifiers, source, year).

Every reader pushes its column list to the parquet scan; ids are "<Prefix>:<key>".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_CLASSES = {
    "Customer": ("customer", "c_custkey", "C"),
    "Order": ("orders", "o_orderkey", "O"),
    "Part": ("part", "p_partkey", "P"),
    "Supplier": ("supplier", "s_suppkey", "S"),
    "Nation": ("nation", "n_nationkey", "N"),
    "Region": ("region", "r_regionkey", "R"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


@dataclass
class Graph:
    """nodes and edges; ``symmetric`` names the predicates that are walked in both directions."""

    nodes: DataFrame
    edges: DataFrame
    symmetric: frozenset[str]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t).select(node_id(p, k).alias("id"), F.lit(c).alias("class")) for c, (t, k, p) in NODE_CLASSES.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _edge(df: DataFrame, s: Column, p: str, o: Column, qualifier: Column | None = None, source: Column | None = None, year: Column | None = None) -> DataFrame:
    return df.select(
        s.alias("subject"),
        F.lit(p).alias("predicate"),
        o.alias("object"),
        (qualifier if qualifier is not None else F.lit(None).cast("string")).alias("qualifier"),
        (source if source is not None else F.lit(p.lower())).alias("source"),
        (year if year is not None else F.lit(None).cast("int")).cast("int").alias("year"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    supplier, nation, customer = (load(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    other = nation.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("region"))
    near = nation.join(F.broadcast(other), (F.col("n_regionkey") == F.col("region")) & (F.col("n_nationkey") < F.col("other")))  # a fixed list of nations
    return (
        _edge(orders, node_id("C", "o_custkey"), "PLACED", node_id("O", "o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate"))
        .unionByName(_edge(items, node_id("O", "l_orderkey"), "CONTAINS", node_id("P", "l_partkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.year("l_shipdate")))
        .unionByName(_edge(items, node_id("O", "l_orderkey"), "FROM", node_id("S", "l_suppkey"), F.col("l_returnflag"), F.col("l_linestatus"), F.year("l_shipdate")))
        .unionByName(_edge(supplier, node_id("S", "s_suppkey"), "IN", node_id("N", "s_nationkey")))
        .unionByName(_edge(customer, node_id("C", "c_custkey"), "LIVES_IN", node_id("N", "c_nationkey"), F.col("c_mktsegment")))
        .unionByName(_edge(nation, node_id("N", "n_nationkey"), "IN_REGION", node_id("R", "n_regionkey")))
        .unionByName(_edge(near, node_id("N", "n_nationkey"), "NEAR", node_id("N", "other")))
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), frozenset({"NEAR"}))


#: The same view in SQL, for the oracles.
EDGES_SQL = """edges AS (
  SELECT 'C:' || o_custkey AS subject, 'PLACED' AS predicate, 'O:' || o_orderkey AS object, o_orderpriority AS qualifier, o_orderstatus AS source, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'CONTAINS', 'P:' || l_partkey, l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) FROM lineitem
  UNION ALL SELECT 'O:' || l_orderkey, 'FROM', 'S:' || l_suppkey, l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) FROM lineitem
  UNION ALL SELECT 'S:' || s_suppkey, 'IN', 'N:' || s_nationkey, NULL, 'in', NULL FROM supplier
  UNION ALL SELECT 'C:' || c_custkey, 'LIVES_IN', 'N:' || c_nationkey, c_mktsegment, 'lives_in', NULL FROM customer
  UNION ALL SELECT 'N:' || n_nationkey, 'IN_REGION', 'R:' || n_regionkey, NULL, 'in_region', NULL FROM nation
  UNION ALL SELECT 'N:' || a.n_nationkey, 'NEAR', 'N:' || b.n_nationkey, NULL, 'near', NULL FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
)"""
NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT '{p}:' || {k} AS id, '{c}' AS class FROM {t}" for c, (t, k, p) in NODE_CLASSES.items()) + ")"
DEGREE_SQL = "degree AS (SELECT node AS id, count(*) AS degree FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1)"
