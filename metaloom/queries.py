"""One query per operator over the driver's tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, stats
from .operators import assemble, evaluate, graph, rank, similarity, temporal, validate
from .plans import metapath
from .sources.graph_view import DEGREE_SQL, EDGES_SQL, NODES_SQL, Graph, load
from .sources.graph_view import graph as star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(col: Column, places: int = 6) -> Column:
    return F.round(col, places)


WITH_EDGES = f"WITH {EDGES_SQL} "
WITH_GRAPH = f"WITH {EDGES_SQL}, {NODES_SQL}, {DEGREE_SQL} "

# ---------------------------------------------------------------- graph


@query(WITH_EDGES + "SELECT predicate, qualifier, count(*) AS n FROM edges WHERE predicate = 'CONTAINS' AND qualifier = 'R' AND year >= 1995 GROUP BY 1, 2")
def edge_scan_filter(spark, sf):
    e = star(spark, sf).edges
    return e.where((F.col("predicate") == "CONTAINS") & (F.col("qualifier") == "R") & (F.col("year") >= 1995)).groupBy("predicate", "qualifier").agg(F.count("*").alias("n"))


@query(WITH_EDGES + "SELECT node AS id, count(*) AS degree FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1")
def global_degree(spark, sf):
    return graph.degree(star(spark, sf).edges)


@query(WITH_EDGES + "SELECT node AS id, count(*) AS degree FROM (SELECT subject AS node FROM edges WHERE predicate <> 'CONTAINS' UNION ALL SELECT object FROM edges WHERE predicate <> 'CONTAINS') GROUP BY 1")
def degree_without_held_out(spark, sf):
    return graph.degree_without(star(spark, sf).edges, ["CONTAINS"])


@query(WITH_EDGES + "SELECT predicate, node AS id, count(*) AS degree FROM (SELECT predicate, subject AS node FROM edges UNION ALL SELECT predicate, object FROM edges) GROUP BY 1, 2")
def metaedge_degree(spark, sf):
    return graph.predicate_degree(star(spark, sf).edges)


@query(WITH_GRAPH + "SELECT degree AS cut FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degree) WHERE i = least(CAST(floor(n * 99.0 / 100) AS BIGINT), n - 1)")
def hub_cut_nearest_rank(spark, sf):
    return graph.nearest_rank(graph.degree(star(spark, sf).edges), "degree", 99.0)


@query(WITH_GRAPH + "SELECT id, degree FROM nodes JOIN degree USING (id) WHERE class IN ('Supplier', 'Nation') AND degree > 60")
def hub_nodes(spark, sf):
    g = star(spark, sf)
    return graph.hubs(g.nodes, graph.degree(g.edges), ["Supplier", "Nation"], 60)


@query(WITH_EDGES + "SELECT object AS id, count(*) AS members FROM edges WHERE predicate = 'CONTAINS' GROUP BY 1 HAVING count(*) > 35")
def oversized_objects(spark, sf):
    return graph.oversized(star(spark, sf).edges, "CONTAINS", 35)


@query(f"WITH {NODES_SQL} SELECT class, count(*) AS n FROM nodes GROUP BY 1")
def class_counts(spark, sf):
    return graph.class_counts(star(spark, sf).nodes)


@query(WITH_GRAPH + "SELECT s.class AS subject_class, predicate, o.class AS object_class, count(*) AS n FROM edges JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object GROUP BY 1, 2, 3")
def triple_counts(spark, sf):
    return graph.triple_counts(star(spark, sf))


@query(WITH_GRAPH + "SELECT subject, predicate, object, 'object' AS missing FROM edges WHERE object NOT IN (SELECT id FROM nodes WHERE class <> 'Region') UNION ALL SELECT subject, predicate, object, 'subject' FROM edges WHERE subject NOT IN (SELECT id FROM nodes WHERE class <> 'Region')")
def dangling_edges(spark, sf):
    g = star(spark, sf)
    return graph.dangling(Graph(g.nodes.where(F.col("class") != "Region"), g.edges, g.symmetric))


@query(WITH_GRAPH + "SELECT id, class FROM nodes WHERE id NOT IN (SELECT id FROM degree)")
def orphan_nodes(spark, sf):
    return graph.orphans(star(spark, sf))


@query(WITH_GRAPH + "SELECT direction, predicate, class, count(DISTINCT id) AS neighbours, count(*) AS edges FROM (SELECT 'out' AS direction, predicate, object AS id FROM edges WHERE subject = 'N:3' UNION ALL SELECT 'in', predicate, subject FROM edges WHERE object = 'N:3') JOIN nodes USING (id) GROUP BY 1, 2, 3")
def profile_groups(spark, sf):
    return graph.profile(star(spark, sf), "N:3")


@query(WITH_EDGES + "SELECT predicate, subject, object, total FROM (SELECT *, count(*) OVER () AS total FROM edges WHERE subject = 'N:3' OR object = 'N:3') ORDER BY predicate, subject, object, qualifier, year LIMIT 50")
def neighbourhood(spark, sf):
    return graph.neighbourhood(star(spark, sf).edges, "N:3").select("predicate", "subject", "object", "total")


def _chain(spark, sf) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 3 != 0, (F.col("p_partkey") / 2).cast("long")).alias("up"))


@query("""
WITH RECURSIVE up AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN p_partkey // 2 END AS nxt FROM part),
walk AS (SELECT k AS id, k AS cur, 0 AS hop FROM up UNION ALL SELECT w.id, u.nxt, hop + 1 FROM walk w JOIN up u ON u.k = w.cur WHERE u.nxt IS NOT NULL AND u.nxt <> w.cur AND hop < 8)
SELECT 'P:' || id AS id, CASE WHEN bool_or(cur = 0 AND 0 NOT IN (SELECT k FROM up)) THEN NULL ELSE 'P:' || arg_max(cur, hop) END AS resolved FROM walk GROUP BY id
""")
def alias_chain(spark, sf):
    c = _chain(spark, sf).where("up is null or up <> k")
    tag = lambda x: F.concat(F.lit("P:"), x.cast("string"))
    ids = load(spark, sf, "part").select(tag(F.col("p_partkey")).alias("id"))
    al = c.where("up is not null").select(tag(F.col("k")).alias("subject"), tag(F.col("up")).alias("object"), F.lit(1).alias("ordinal"))
    return graph.resolve_aliases(ids, al, ids)


@query("""
WITH RECURSIVE pairs AS (SELECT 'S:' || s_suppkey AS a, 'N:' || s_nationkey AS b FROM supplier UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
bfs AS (SELECT 'R:0' AS id, 0 AS distance UNION SELECT b, distance + 1 FROM bfs JOIN both_ways ON a = id WHERE distance < 4)
SELECT id, min(distance) AS distance FROM bfs GROUP BY id
""")
def bfs_distance(spark, sf):
    e = star(spark, sf).edges.where(F.col("predicate").isin("IN", "LIVES_IN", "IN_REGION")).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return graph.distances(e, spark.createDataFrame([("R:0",)], "id string"), 4)


# ---------------------------------------------------------------- metapaths

M1 = metapath.parse("placed_from_in", ["Customer", "PLACED", "Order", "FROM", "Supplier", "IN", "Nation"])
REVERSE = metapath.parse("part_to_customer", ["Part", "<CONTAINS", "Order", "<PLACED", "Customer"])
PDP = metapath.parse("supplier_order_supplier", ["Supplier", "<FROM", "Order", "FROM", "Supplier"])
SYMMETRIC = metapath.parse("nation_near_region", ["Supplier", "IN", "Nation", "NEAR", "Nation", "IN_REGION", "Region"])
CONSTRAINED = metapath.parse("returned_parts", ["Customer", "PLACED", "Order", "CONTAINS", "Part"], {"CONTAINS": "R"})


def _walked(spark, sf, path, **options) -> DataFrame:
    g = star(spark, sf)
    return metapath.walk(g, path, graph.degree(g.edges), **options).select("start", "end", r(F.col("score"), 9).alias("score"), "paths")


def _w(a: str) -> str:
    return f"pow((SELECT degree FROM degree d WHERE d.id = {a}), -0.4)"


_M1_SQL = WITH_GRAPH + """SELECT e1.subject AS start, e3.object AS end_, sum(pow(d1.degree, -0.4) * pow(d2.degree, -0.4) * pow(d3.degree, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN edges e2 ON e2.subject = e1.object AND e2.predicate = 'FROM' JOIN edges e3 ON e3.subject = e2.object AND e3.predicate = 'IN'
JOIN degree d1 ON d1.id = e1.object JOIN degree d2 ON d2.id = e2.object JOIN degree d3 ON d3.id = e3.object WHERE e1.predicate = 'PLACED' {more} GROUP BY 1, 2"""


def _renamed(inner: str) -> str:
    return f'SELECT start, end_ AS "end", round(score, 9) AS score, paths FROM ({inner})'


@query(_renamed(_M1_SQL.format(more="")))
def metapath_dwpc_m1(spark, sf):
    return _walked(spark, sf, M1)


@query(_renamed(_M1_SQL.format(more="AND d2.degree <= 650")))
def metapath_hub_excluded(spark, sf):
    g = star(spark, sf)
    d = graph.degree(g.edges)
    return metapath.walk(g, M1, d, blocked=graph.hubs(g.nodes, d, ["Supplier"], 650)).select("start", "end", r(F.col("score"), 9).alias("score"), "paths")


@query(_renamed(WITH_GRAPH + """SELECT e1.object AS start, e2.subject AS end_, sum(pow(d1.degree, -0.4) * pow(d2.degree, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN edges e2 ON e2.object = e1.subject AND e2.predicate = 'PLACED' JOIN degree d1 ON d1.id = e1.subject JOIN degree d2 ON d2.id = e2.subject WHERE e1.predicate = 'CONTAINS' GROUP BY 1, 2"""))
def metapath_reverse_hop(spark, sf):
    return _walked(spark, sf, REVERSE)


@query(_renamed(WITH_GRAPH + """SELECT e1.object AS start, e2.object AS end_, sum(pow(d1.degree, -0.4) * pow(d2.degree, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN edges e2 ON e2.subject = e1.subject AND e2.predicate = 'FROM' AND e2.object <> e1.object JOIN degree d1 ON d1.id = e1.subject JOIN degree d2 ON d2.id = e2.object WHERE e1.predicate = 'FROM' GROUP BY 1, 2"""))
def metapath_pdp(spark, sf):
    return _walked(spark, sf, PDP)


@query(_renamed(WITH_GRAPH + """, near AS (SELECT subject AS a, object AS b FROM edges WHERE predicate = 'NEAR' UNION ALL SELECT object, subject FROM edges WHERE predicate = 'NEAR')
SELECT e1.subject AS start, e3.object AS end_, sum(pow(d1.degree, -0.4) * pow(d2.degree, -0.4) * pow(d3.degree, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN near ON near.a = e1.object JOIN edges e3 ON e3.subject = near.b AND e3.predicate = 'IN_REGION' JOIN degree d1 ON d1.id = e1.object JOIN degree d2 ON d2.id = near.b JOIN degree d3 ON d3.id = e3.object
WHERE e1.predicate = 'IN' AND near.a <> near.b GROUP BY 1, 2"""))
def metapath_with_symmetric_hop(spark, sf):
    return _walked(spark, sf, SYMMETRIC)


@query(_renamed(WITH_GRAPH + """SELECT e1.subject AS start, e2.object AS end_, sum(pow(d1.degree, -0.4) * pow(d2.degree, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN edges e2 ON e2.subject = e1.object AND e2.predicate = 'CONTAINS' AND e2.qualifier = 'R' JOIN degree d1 ON d1.id = e1.object JOIN degree d2 ON d2.id = e2.object WHERE e1.predicate = 'PLACED' GROUP BY 1, 2"""))
def metapath_constraint(spark, sf):
    return _walked(spark, sf, CONSTRAINED)


@query(_renamed(WITH_GRAPH + """, o AS (SELECT predicate, subject AS id, count(*) AS d FROM edges GROUP BY 1, 2), i AS (SELECT predicate, object AS id, count(*) AS d FROM edges GROUP BY 1, 2)
SELECT e1.subject AS start, e2.object AS end_, sum(pow(o1.d * i1.d, -0.4) * pow(o2.d * i2.d, -0.4)) AS score, count(*) AS paths
FROM edges e1 JOIN edges e2 ON e2.subject = e1.object AND e2.predicate = 'FROM'
JOIN o o1 ON o1.predicate = 'PLACED' AND o1.id = e1.subject JOIN i i1 ON i1.predicate = 'PLACED' AND i1.id = e1.object JOIN o o2 ON o2.predicate = 'FROM' AND o2.id = e2.subject JOIN i i2 ON i2.predicate = 'FROM' AND i2.id = e2.object
WHERE e1.predicate = 'PLACED' GROUP BY 1, 2"""))
def metapath_edge_scheme(spark, sf):
    return _walked(spark, sf, metapath.parse("placed_from", ["Customer", "PLACED", "Order", "FROM", "Supplier"]), scheme="edge")


@query(f"SELECT count(DISTINCT start) AS starts, count(DISTINCT end_) AS ends, count(*) AS pairs, CAST(sum(paths) AS BIGINT) AS paths FROM ({_M1_SQL.format(more='')})")
def metapath_reach(spark, sf):
    g = star(spark, sf)
    return metapath.reach(metapath.walk(g, M1, graph.degree(g.edges)))


@query("SELECT * FROM (VALUES ('placed_from_in', ''), ('ships_to', 'SHIPS_TO'), ('two_unknown', 'OWNS|SHIPS_TO')) AS t(metapath, missing)")
def blocked_channels(spark, sf):
    g = star(spark, sf)
    return metapath.missing_predicates(g, [M1, metapath.parse("ships_to", ["Supplier", "SHIPS_TO", "Nation"]), metapath.parse("two_unknown", ["Customer", "OWNS", "Part", "SHIPS_TO", "Nation"])])


@query(WITH_EDGES + "SELECT DISTINCT a.subject, a.object FROM edges a JOIN edges b ON a.subject = b.subject AND a.object = b.object WHERE a.predicate = 'CONTAINS' AND b.predicate = 'CONTAINS' AND a.qualifier = 'R' AND b.qualifier = 'N'")
def contradiction_semijoin(spark, sf):
    e = star(spark, sf).edges.where(F.col("predicate") == "CONTAINS")
    one, other = e.where("qualifier = 'R'").select("subject", "object").distinct(), e.where("qualifier = 'N'").select("subject", "object")
    return one.join(other, ["subject", "object"], "left_semi")


@query(WITH_EDGES + """, m1 AS (SELECT 1 AS route, a.object AS via, b.object AS target FROM edges a JOIN edges b ON b.subject = a.object AND b.predicate = 'FROM' WHERE a.subject = 'C:7' AND a.predicate = 'PLACED'),
m2 AS (SELECT 2 AS route, a.object AS via, b.object AS target FROM edges a JOIN edges b ON b.subject = a.object AND b.predicate = 'CONTAINS' WHERE a.subject = 'C:7' AND a.predicate = 'PLACED')
SELECT route, via, target FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) ORDER BY route, via, target LIMIT 25""")
def route_enumeration(spark, sf):
    e = star(spark, sf).edges
    first = e.where("subject = 'C:7' and predicate = 'PLACED'").select(F.col("object").alias("via"))
    step = lambda p, i: first.join(e.where(F.col("predicate") == p).select(F.col("subject").alias("via"), F.col("object").alias("target")), "via").select(F.lit(i).alias("route"), "via", "target")
    return step("FROM", 1).unionByName(step("CONTAINS", 2)).orderBy("route", "via", "target").limit(25)


# ---------------------------------------------------------------- ranking


def _balances(spark, sf) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") / 100).cast("long").alias("score"), (F.col("c_mktsegment") == "BUILDING").alias("positive"))


_BAL = "bal AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal / 100) AS BIGINT) AS score, c_mktsegment = 'BUILDING' AS positive FROM customer)"


@query(f"WITH {_BAL} SELECT c_custkey, round(CASE WHEN n = 1 THEN 1.0 ELSE (rk - 1 + (peers - 1) / 2.0) / (n - 1) END, 6) AS percentile FROM (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY score) AS rk, count(*) OVER (PARTITION BY c_nationkey, score) AS peers, count(*) OVER (PARTITION BY c_nationkey) AS n FROM bal)")
def midrank_percentile(spark, sf):
    return rank.midrank_percentile(_balances(spark, sf), "score", ["c_nationkey"]).select("c_custkey", r(F.col("percentile")).alias("percentile"))


@query(f"WITH {_BAL} SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY score) + (count(*) OVER (PARTITION BY c_nationkey, score) - 1) / 2.0 AS avg_rank FROM bal")
def average_rank(spark, sf):
    return rank.average_rank(_balances(spark, sf), "score", ["c_nationkey"]).select("c_custkey", "avg_rank")


@query(f"WITH {_BAL} SELECT c_custkey, CAST(least(9, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY score, c_custkey) - 1) * 10) // count(*) OVER (PARTITION BY c_nationkey)) AS INTEGER) AS bin FROM bal")
def degree_bins_floor(spark, sf):
    return rank.equal_count_bins(_balances(spark, sf), ["c_nationkey"], ["score", "c_custkey"], 10).select("c_custkey", "bin")


@query(WITH_GRAPH + "SELECT CAST(floor(log2(degree)) AS INTEGER) AS bin, count(*) AS n FROM degree GROUP BY 1")
def degree_log2_bins(spark, sf):
    return graph.degree(star(spark, sf).edges).groupBy(rank.log2_bin(F.col("degree")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_BAL} SELECT c_nationkey, c_custkey, score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS INTEGER) AS position FROM bal) WHERE position <= 5")
def topk_deterministic(spark, sf):
    return rank.top_k(_balances(spark, sf), ["c_nationkey"], [F.desc("score"), F.asc("c_custkey")], 5).select("c_nationkey", "c_custkey", "score", "position")


_HITS = f"""WITH {_BAL}, x AS (SELECT c_nationkey, score AS v, count(*) AS c, count(*) FILTER (positive) AS p FROM bal GROUP BY 1, 2),
y AS (SELECT *, sum(c) OVER (PARTITION BY c_nationkey ORDER BY v DESC) - c AS b FROM x)
SELECT c_nationkey, CAST(sum(c) AS BIGINT) AS pool, CAST(sum(p) AS BIGINT) AS positives,
CAST(sum(CASE WHEN b + c <= 10 THEN p WHEN b < 10 THEN greatest(0, 10 - b - (c - p)) ELSE 0 END) AS BIGINT) AS hits_min,
CAST(sum(CASE WHEN b + c <= 10 THEN p WHEN b < 10 THEN least(p, 10 - b) ELSE 0 END) AS BIGINT) AS hits_max,
round(sum(CASE WHEN b + c <= 10 THEN p WHEN b < 10 THEN p * (10 - b) / c ELSE 0.0 END), 6) AS hits_expected,
max(CASE WHEN b < 10 AND b + c > 10 AND c > 1 THEN c ELSE 0 END) AS tie_at_cut FROM y GROUP BY 1"""


@query(_HITS)
def hits_at_k_range(spark, sf):
    out = rank.hits_range(_balances(spark, sf), "score", "positive", ["c_nationkey"], 10)
    return out.withColumn("hits_expected", r(F.col("hits_expected")))


@query(f"""WITH {_BAL}, x AS (SELECT c_nationkey, score AS v, count(*) AS c, count(*) FILTER (positive) AS p FROM bal GROUP BY 1, 2),
y AS (SELECT *, sum(c) OVER (PARTITION BY c_nationkey ORDER BY v DESC) - c AS b FROM x), f AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY b) AS i FROM y WHERE p > 0)
SELECT c_nationkey, round(1 / (b + 1), 6) AS mrr_max, round(1 / (b + c - p + 1), 6) AS mrr_min FROM f WHERE i = 1""")
def mrr_range(spark, sf):
    out = rank.mrr_range(_balances(spark, sf), "score", "positive", ["c_nationkey"])
    return out.select("c_nationkey", r(F.col("mrr_max")).alias("mrr_max"), r(F.col("mrr_min")).alias("mrr_min"))


@query(f"WITH {_BAL}, c AS (SELECT score, count(*) AS c FROM bal GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS distinct_values, max(c) AS largest_tie, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS tied_share FROM c")
def score_degeneracy(spark, sf):
    return rank.degeneracy(_balances(spark, sf), "score").withColumn("tied_share", r(F.col("tied_share")))


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS channel, CAST(round(max(o_totalprice)) AS BIGINT) AS score FROM orders GROUP BY 1, 2),
p AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY score) AS rk, count(*) OVER (PARTITION BY channel, score) AS peers, count(*) OVER (PARTITION BY channel) AS n FROM s)
SELECT o_custkey, round(max(CASE WHEN n = 1 THEN 1.0 ELSE (rk - 1 + (peers - 1) / 2.0) / (n - 1) END * CASE channel WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.5 ELSE 0.25 END), 6) AS score FROM p WHERE channel IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def combine_max(spark, sf):
    s = load(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("channel")).agg(F.round(F.max("o_totalprice")).cast("long").alias("score")).withColumn("all", F.lit(1))
    w = spark.createDataFrame([("1-URGENT", 1.0), ("2-HIGH", 0.5), ("3-MEDIUM", 0.25)], "channel string, weight double")
    return evaluate.combine_channels(s, w, ["all"], "channel", "o_custkey").select("o_custkey", r(F.col("score")).alias("score"))


@query("""WITH x AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT p_brand, round(corr(a, b), 6) AS rho FROM x GROUP BY 1""")
def spearman_by_group(spark, sf):
    return evaluate.spearman(load(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", r(F.col("rho")).alias("rho"))


# ---------------------------------------------------------------- assembly


def _witnesses(spark, sf) -> DataFrame:
    i = load(spark, sf, "lineitem")
    layer = F.element_at(F.array(*map(F.lit, ["chembl", "gtop", "spine"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return i.select(
        F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), assemble.layer_rank(layer).cast("int").alias("layer_rank"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("source"),
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("evidence_tier"),
        F.when(F.col("l_linenumber") == 2, F.lit("1970-01-01")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("first_asserted_date"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("ic50"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("ec50"),
        F.when(F.col("l_returnflag") == "N", F.lit("unknown")).when(F.col("l_linestatus") == "O", F.lit("modulator")).when(F.col("l_returnflag") == "R", F.lit("inhibitor")).otherwise(F.lit("agonist")).alias("direction"),
    )


_WIT = """wit AS (SELECT l_suppkey AS subject, l_partkey AS object, CASE l_linenumber % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 0 END AS layer_rank, l_orderkey * 10 + l_linenumber AS line_no, l_returnflag, l_linestatus,
CAST(l_linenumber % 4 + 1 AS INTEGER) AS evidence_tier, CASE WHEN l_linenumber = 2 THEN '1970-01-01' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d,
CASE WHEN l_quantity > 25 THEN l_quantity END AS ic50, CASE WHEN l_discount > 0.05 THEN l_discount END AS ec50,
CASE WHEN l_returnflag = 'N' THEN 'unknown' WHEN l_linestatus = 'O' THEN 'modulator' WHEN l_returnflag = 'R' THEN 'inhibitor' ELSE 'agonist' END AS direction FROM lineitem)"""


def _merged(spark, sf, **options) -> DataFrame:
    return assemble.merge_edges(_witnesses(spark, sf), ["subject", "object"], **options)


@query(f"""WITH {_WIT}, s AS (SELECT subject, object, string_agg(DISTINCT x, '|' ORDER BY x) AS source FROM (SELECT subject, object, l_returnflag AS x FROM wit UNION ALL SELECT subject, object, l_linestatus FROM wit) GROUP BY 1, 2),
g AS (SELECT subject, object, count(*) AS support_count, min(evidence_tier) AS evidence_tier, coalesce(min(d) FILTER (d NOT LIKE '1970%'), min(d)) AS first_asserted_date FROM wit GROUP BY 1, 2)
SELECT * FROM g JOIN s USING (subject, object)""")
def edge_merge_support(spark, sf):
    return _merged(spark, sf).select("subject", "object", "support_count", "evidence_tier", "first_asserted_date", "source")


@query(f"WITH {_WIT} SELECT subject, object, arg_min(ic50, (layer_rank, line_no)) FILTER (ic50 IS NOT NULL) AS ic50, arg_min(ec50, (layer_rank, line_no)) FILTER (ec50 IS NOT NULL) AS ec50 FROM wit GROUP BY 1, 2")
def precedence_first_nonnull(spark, sf):
    return _merged(spark, sf, precedence=["ic50", "ec50"]).select("subject", "object", "ic50", "ec50")


@query(f"WITH {_WIT} SELECT subject, object, coalesce(bool_and(ic50 IS NULL AND ec50 IS NULL), true) AS unquantified FROM wit GROUP BY 1, 2")
def derived_absence(spark, sf):
    return _merged(spark, sf, precedence=["ic50", "ec50"], derived_absence={"unquantified": ["ic50", "ec50"]}).select("subject", "object", "unquantified")


@query(f"""WITH {_WIT}, k AS (SELECT subject, object, direction, CASE direction WHEN 'unknown' THEN 0 WHEN 'modulator' THEN 1 ELSE 2 END AS rk FROM wit),
t AS (SELECT subject, object, max(rk) AS top FROM k GROUP BY 1, 2) SELECT subject, object, CASE WHEN count(DISTINCT direction) > 1 THEN 'contested' ELSE min(direction) END AS direction FROM k JOIN t USING (subject, object) WHERE rk = top GROUP BY 1, 2""")
def ladder_resolution(spark, sf):
    return _merged(spark, sf, ladders=assemble.LADDERS).select("subject", "object", "direction")


@query("""WITH rows_ AS (SELECT l_partkey AS id, CASE WHEN l_tax > 0.06 THEN 'B' ELSE 'A' END AS class, l_linenumber % 3 AS layer_rank, l_orderkey * 10 + l_linenumber AS line_no, l_returnflag AS flag, CASE WHEN l_discount > 0.04 THEN l_linestatus END AS status FROM lineitem),
f AS (SELECT id, arg_min(class, (layer_rank, line_no)) AS class FROM rows_ GROUP BY 1)
SELECT id, class, arg_min(flag, (layer_rank, line_no)) FILTER (flag IS NOT NULL) AS flag, arg_min(status, (layer_rank, line_no)) FILTER (status IS NOT NULL) AS status, CAST(count(DISTINCT flag) > 1 AS INTEGER) + CAST(count(DISTINCT status) > 1 AS INTEGER) AS conflicts FROM rows_ JOIN f USING (id, class) GROUP BY 1, 2""")
def node_merge_conflicts(spark, sf):
    i = load(spark, sf, "lineitem")
    line = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "_metadata.file_path", "_metadata.row_index")  # numbers repeat; the row that the table has first is the first line
    rows = i.select(F.col("l_partkey").alias("id"), F.when(F.col("l_tax") > 0.06, "B").otherwise("A").alias("class"), (F.col("l_linenumber") % 3).alias("layer_rank"), line.alias("line_no"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_discount") > 0.04, F.col("l_linestatus")).alias("status"))
    return assemble.merge_nodes(rows, ["flag", "status"])


@query("""WITH RECURSIVE w AS (SELECT l_suppkey AS k, l_partkey AS o, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber % 3, l_orderkey * 10 + l_linenumber, CASE WHEN l_discount > 0.03 THEN l_quantity END NULLS FIRST, CASE WHEN l_tax > 0.02 THEN l_quantity - 5 END NULLS FIRST) AS i, CASE WHEN l_discount > 0.03 THEN l_quantity END AS x, CASE WHEN l_tax > 0.02 THEN l_quantity - 5 END AS lo, CASE WHEN l_tax > 0.02 THEN l_quantity + 5 END AS hi FROM lineitem),
f AS (SELECT k, o, i, x, lo, hi FROM w WHERE i = 1 UNION ALL
SELECT k, o, i, x, CASE WHEN lo <= x AND x <= hi THEN lo END, CASE WHEN lo <= x AND x <= hi THEN hi END FROM (SELECT f.k, f.o, w.i, coalesce(f.x, w.x) AS x, coalesce(f.lo, w.lo) AS lo, coalesce(f.hi, w.hi) AS hi FROM f JOIN w ON w.k = f.k AND w.o = f.o AND w.i = f.i + 1))
SELECT k AS subject, o AS object, arg_max(struct_pack(x, lo, hi), i).x AS potency, arg_max(struct_pack(x, lo, hi), i).lo AS low, arg_max(struct_pack(x, lo, hi), i).hi AS high FROM f GROUP BY 1, 2""")
def potency_range_fold(spark, sf):
    i = load(spark, sf, "lineitem")
    w = i.select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), (F.col("l_linenumber") % 3).alias("layer_rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.when(F.col("l_discount") > 0.03, F.col("l_quantity")).alias("potency"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity") - 5).alias("low"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity") + 5).alias("high"))
    return assemble.fold_potency(w, ["subject", "object"])


@query("""WITH a AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS c FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY ALL), b AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS c FROM orders WHERE year(o_orderdate) > 1996 GROUP BY ALL)
SELECT o_custkey, o_orderstatus, o_orderpriority, coalesce(b.c, 0) - coalesce(a.c, 0) AS change FROM a FULL JOIN b USING (o_custkey, o_orderstatus, o_orderpriority) WHERE coalesce(b.c, 0) <> coalesce(a.c, 0)""")
def multiset_diff(spark, sf):
    o = load(spark, sf, "orders")
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return assemble.multiset_diff(o.where(F.year("o_orderdate") <= 1996).select(*cols), o.where(F.year("o_orderdate") > 1996).select(*cols))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'intersection', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'difference', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def set_operations(spark, sf):
    o = load(spark, sf, "orders")
    f, u = o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", f.union(u).distinct()).unionByName(n("intersection", f.intersect(u))).unionByName(n("difference", f.subtract(u)))


# ---------------------------------------------------------------- validation


@query("""SELECT 'C:' || c_custkey AS id, v AS violation FROM (
SELECT c_custkey, unnest(list_filter([CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'ENUM:segment' END, CASE WHEN c_acctbal < 0 THEN 'RANGE:balance' END, CASE WHEN c_acctbal > 9000 THEN 'RANGE:balance' END], lambda x: x IS NOT NULL)) AS v FROM customer)""")
def node_violations(spark, sf):
    c = load(spark, sf, "customer")
    nodes = c.select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Customer").alias("class"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    rule = validate.NodeClass("Customer", ("C",), {"segment": validate.Property(values=("BUILDING", "MACHINERY", "AUTOMOBILE")), "balance": validate.Property("float", least=0, most=9000)})
    return validate.validate_nodes(nodes, [rule])


@query(WITH_GRAPH + "SELECT predicate, CASE WHEN predicate = 'FROM' THEN 'UNDECLARED_TRIPLE' WHEN predicate = 'IN_REGION' THEN 'UNKNOWN_PREDICATE' ELSE 'MISSING_QUALIFIER' END AS code, count(*) AS n FROM edges WHERE predicate IN ('FROM', 'IN_REGION', 'IN') GROUP BY 1, 2")
def edge_violations(spark, sf):
    g = star(spark, sf)
    e = validate.EdgeClass
    rules = [e("Customer", "PLACED", "Order"), e("Order", "CONTAINS", "Part"), e("Customer", "FROM", "Supplier"), e("any", "IN", "Nation", required=("qualifier",)), e("Customer", "LIVES_IN", "any"), e("Nation", "NEAR", "Nation", symmetric=True)]
    v = validate.validate_edges(g.edges, g.nodes, rules)
    return v.groupBy("predicate", F.substring_index("violation", ":", 1).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN NOT l_quantity > 5 THEN 'quantity' WHEN NOT l_discount > 0.02 THEN 'discount' WHEN NOT l_returnflag = 'N' THEN 'flag' ELSE 'kept' END AS gate, count(*) AS n FROM lineitem GROUP BY 1")
def gate_census(spark, sf):
    return validate.gate_census(load(spark, sf, "lineitem"), [("quantity", F.col("l_quantity") > 5), ("discount", F.col("l_discount") > 0.02), ("flag", F.col("l_returnflag") == "N")])


# ---------------------------------------------------------------- labels and evaluation


def _measured(spark, sf) -> DataFrame:
    i = load(spark, sf, "lineitem")
    rel = F.when(F.col("l_returnflag") == "R", ">").when(F.col("l_returnflag") == "A", "<").when(F.col("l_linestatus") == "O", "=")
    return i.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(F.col("l_discount") > 0.02, F.col("l_quantity") * 400).alias("ec50_nm"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") / 2).alias("ic50_nm"), rel.alias("relation"), (F.col("l_linenumber") == 1).alias("imputed"))


_VERD = """m AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_discount > 0.02 THEN l_quantity * 400 END AS a, CASE WHEN l_tax > 0.01 THEN l_extendedprice / 2 END AS b, CASE WHEN l_returnflag = 'R' THEN '>' WHEN l_returnflag = 'A' THEN '<' ELSE '=' END AS rel, l_linenumber = 1 AS imp FROM lineitem),
v1 AS (SELECT *, CASE WHEN rel = '=' THEN a <= 10000 WHEN rel = '>' THEN CASE WHEN a >= 10000 THEN false END ELSE CASE WHEN a <= 10000 THEN true END END AS va, CASE WHEN rel = '=' THEN b <= 10000 WHEN rel = '>' THEN CASE WHEN b >= 10000 THEN false END ELSE CASE WHEN b <= 10000 THEN true END END AS vb, coalesce(a, b) AS f FROM m),
v2 AS (SELECT *, CASE WHEN rel = '=' THEN f <= 10000 WHEN rel = '>' THEN CASE WHEN f >= 10000 THEN false END ELSE CASE WHEN f <= 10000 THEN true END END AS vf, CASE WHEN f >= 10000 THEN false END AS vgt FROM v1),
verdicts AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN (va IS NOT NULL AND vb IS NOT NULL AND va <> vb) OR (imp AND vf IS DISTINCT FROM vgt) THEN NULL ELSE vf END AS verdict FROM v2)"""


def _verdicts(spark, sf) -> DataFrame:
    return _measured(spark, sf).withColumn("verdict", scalar.classify([F.col("ec50_nm"), F.col("ic50_nm")], F.col("relation"), F.col("imputed")))


@query(f"WITH {_VERD} SELECT l_orderkey, l_linenumber, verdict FROM verdicts")
def verdict_rules(spark, sf):
    return _verdicts(spark, sf).select("l_orderkey", "l_linenumber", "verdict")


@query(f"WITH {_VERD} SELECT l_suppkey, l_partkey, bool_or(verdict) AS label FROM verdicts WHERE verdict IS NOT NULL GROUP BY 1, 2 HAVING bool_or(verdict) <> bool_or(NOT verdict)")
def label_sets_ambiguous_removed(spark, sf):
    return evaluate.label_sets(_verdicts(spark, sf), "l_suppkey", "l_partkey", "verdict")


def _doc_scores(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = load(spark, sf, "documents")
    scores = d.where("n_chars >= 500").select("lang", "doc_id", F.round(F.col("n_chars") / 100).alias("score"))
    labels = d.select("lang", "doc_id").join(load(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("label")), "doc_id")
    return scores, labels


@query("""WITH sc AS (SELECT lang, doc_id, round(n_chars / 100) AS score FROM documents WHERE n_chars >= 500), mn AS (SELECT lang, min(score) - 1 AS imp FROM sc GROUP BY 1),
x AS (SELECT d.lang, l.quality = 1 AS label, sc.score IS NOT NULL AS scored, coalesce(sc.score, mn.imp, -1) AS s FROM documents d JOIN labels l USING (doc_id) LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.lang = d.lang LEFT JOIN mn ON mn.lang = d.lang),
rk AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS mid FROM x),
g AS (SELECT lang, count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg, count(*) FILTER (label AND scored) AS k, count(*) FILTER (NOT label AND scored) AS j, sum(mid) FILTER (label) AS rs FROM rk GROUP BY 1),
a AS (SELECT *, (rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc, (k * n_neg + 0.5 * (n_pos - k) * (n_neg - j)) / (n_pos * n_neg) AS ceiling, (0.5 * k * j + k * (n_neg - j) + 0.5 * (n_pos - k) * (n_neg - j)) / (n_pos * n_neg) AS flo FROM g WHERE n_pos > 0 AND n_neg > 0)
SELECT lang, n_pos, n_neg, round(auc, 6) AS auc, round(flo, 6) AS floor, round(ceiling, 6) AS ceiling, round(CASE WHEN ceiling - flo > 1e-12 THEN (auc - flo) / (ceiling - flo) END, 6) AS skill FROM a""")
def auc_midrank(spark, sf):
    out = evaluate.auc(*_doc_scores(spark, sf), ["lang"], "doc_id").where("n_pos > 0 and n_neg > 0")
    return out.select("lang", "n_pos", "n_neg", *[r(F.col(c)).alias(c) for c in ("auc", "floor", "ceiling", "skill")])


@query(f"""WITH h AS ({_HITS}), t AS (SELECT c_nationkey, pool, positives, hits_min, hits_max, unnest(generate_series(hits_min, least(10, positives))) AS i FROM h),
lc AS (SELECT c_nationkey, sum(exp(lgamma(positives + 1) - lgamma(i + 1) - lgamma(positives - i + 1) + lgamma(pool - positives + 1) - lgamma(10 - i + 1) - lgamma(pool - positives - 10 + i + 1) - lgamma(pool + 1) + lgamma(11) + lgamma(pool - 10 + 1))) AS p FROM t WHERE pool > 10 AND 10 - i <= pool - positives GROUP BY 1)
SELECT h.c_nationkey, pool, positives, hits_min, hits_max, round(positives * least(10, pool) / pool, 6) AS expected, round(least(1.0, p), 6) AS p_min FROM h LEFT JOIN lc ON lc.c_nationkey = h.c_nationkey""")
def lift_row(spark, sf):
    out = evaluate.lift(_balances(spark, sf), "positive", ["c_nationkey"], 10)
    return out.select("c_nationkey", "pool", "positives", "hits_min", "hits_max", r(F.col("expected")).alias("expected"), r(F.col("p_min")).alias("p_min"))


# ---------------------------------------------------------------- time


def _dated(spark, sf) -> DataFrame:
    return star(spark, sf).edges.where(F.col("predicate").isin("PLACED", "FROM", "IN", "LIVES_IN"))


_DATED = WITH_EDGES + ", dated AS (SELECT * FROM edges WHERE predicate IN ('PLACED', 'FROM', 'IN', 'LIVES_IN')) "
_SEEN = _DATED + ", seen AS (SELECT id, min(year) AS year FROM (SELECT subject AS id, year FROM dated UNION ALL SELECT object, year FROM dated) GROUP BY 1) "


@query(_SEEN + "SELECT id, year FROM seen")
def first_seen_year(spark, sf):
    return temporal.first_seen(_dated(spark, sf))


@query(_SEEN + ", c AS (SELECT predicate, CASE WHEN d.year IS NULL AND d.source = 'in' AND s.year IS NOT NULL AND o.year IS NOT NULL THEN greatest(s.year, o.year) ELSE d.year END AS year FROM dated d LEFT JOIN seen s ON s.id = subject LEFT JOIN seen o ON o.id = object) SELECT predicate, year, count(*) AS n FROM c WHERE predicate <> 'PLACED' AND coalesce(year, 0) <= 1996 GROUP BY 1, 2")
def temporal_split_counts(spark, sf):
    e = temporal.date_computed(_dated(spark, sf), ["in"])
    return temporal.training_edges(e, 1996, ["PLACED"]).groupBy("predicate", "year").agg(F.count("*").alias("n"))


def _yearly_labels(spark, sf) -> DataFrame:
    i = load(spark, sf, "lineitem")
    return i.select(F.col("l_suppkey").alias("virus"), F.col("l_partkey").alias("compound"), (F.col("l_quantity") > 25).alias("verdict"), F.year("l_shipdate").alias("year"))


_SIDES = """s AS (SELECT CASE WHEN year(l_shipdate) <= 1995 THEN 'train' ELSE 'test' END AS side, l_suppkey AS virus, l_partkey AS compound, bool_or(l_quantity > 25) AS label FROM lineitem GROUP BY 1, 2, 3 HAVING bool_or(l_quantity > 25) <> bool_or(NOT l_quantity > 25)),
split AS (SELECT * FROM s WHERE side = 'train' UNION ALL SELECT * FROM s WHERE side = 'test' AND (virus, compound, label) NOT IN (SELECT virus, compound, label FROM s WHERE side = 'train'))"""


@query(f"WITH {_SIDES} SELECT side, virus, compound, label FROM split")
def temporal_label_split(spark, sf):
    return temporal.split_labels(_yearly_labels(spark, sf), 1995)


@query(WITH_EDGES + f""", {_SIDES}, train AS (SELECT * FROM edges WHERE predicate NOT IN ('CONTAINS') AND (year IS NULL OR year <= 1995)), touched AS (SELECT subject AS id FROM train UNION SELECT object FROM train)
SELECT 'future_edges' AS "check", count(*) FILTER (year > 1995) AS n FROM train UNION ALL SELECT 'held_out_edges', count(*) FILTER (predicate = 'CONTAINS') FROM train
UNION ALL SELECT 'unreachable_test', count(*) FROM split WHERE side = 'test' AND 'P:' || compound NOT IN (SELECT id FROM touched)
UNION ALL SELECT 'label_overlap', count(*) FROM split a WHERE side = 'test' AND EXISTS (SELECT 1 FROM split b WHERE b.side = 'train' AND a.virus = b.virus AND a.compound = b.compound AND a.label = b.label)""")
def leakage_audit(spark, sf):
    train = temporal.training_edges(star(spark, sf).edges, 1995, ["CONTAINS"])
    labels = temporal.split_labels(_yearly_labels(spark, sf), 1995).withColumn("compound", F.concat(F.lit("P:"), F.col("compound").cast("string")))
    return temporal.audit(train, labels, 1995, ["CONTAINS"])


@query(_DATED + "SELECT source, year, count(*) AS n FROM dated GROUP BY 1, 2")
def year_histogram(spark, sf):
    return temporal.year_histogram(_dated(spark, sf))


@query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def event_windows_batch(spark, sf):
    e = load(spark, sf, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


# ---------------------------------------------------------------- similarity


def _vectors(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("g"))


_COS = """scored AS (SELECT q.vec_id AS query, c.vec_id AS reference, q.label AS ql, c.label AS cl, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS s
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), other AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, reference) AS rk FROM scored WHERE ql <> cl)"""


def _nearest(spark, sf, k: int) -> DataFrame:
    v = _vectors(spark, sf)
    return similarity.query_join(v.where(F.col("id") % 100 == 0), v, similarity.cosine, k, group="g", vector="v")


@query(f"WITH {_COS} SELECT query, CAST(rk AS INTEGER) AS rank, reference, round(s, 6) AS similarity FROM other WHERE rk <= 10")
def similarity_topk(spark, sf):
    return _nearest(spark, sf, 10).withColumn("similarity", r(F.col("similarity")))


@query(f"WITH {_COS} SELECT query, round(max(s) FILTER (rk > 5), 6) AS score, count(*) < 5 AS short FROM other WHERE rk <= 20 GROUP BY 1")
def knn_exclusion_score(spark, sf):
    return similarity.knn_excluding(_nearest(spark, sf, 20), 5).withColumn("score", r(F.col("score")))


@query(f"WITH {_COS} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (m >= t) AS n FROM (SELECT query, max(s) AS m FROM other WHERE rk <= 10 GROUP BY 1), (VALUES (0.1), (0.3), (0.5)) AS th(t) GROUP BY 1")
def similarity_distribution(spark, sf):
    return similarity.similarity_distribution(_nearest(spark, sf, 10), [0.1, 0.3, 0.5])


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type || '/' || day(ts)) AS e FROM events GROUP BY 1)
SELECT a.user_id AS a, b.user_id AS b, round(len(list_intersect(a.e, b.e)) / (len(a.e) + len(b.e) - len(list_intersect(a.e, b.e))), 6) AS similarity FROM u a JOIN u b ON a.user_id < b.user_id
WHERE len(list_intersect(a.e, b.e)) / (len(a.e) + len(b.e) - len(list_intersect(a.e, b.e))) >= 0.33""")
def tanimoto_join(spark, sf):
    u = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.concat_ws("/", "event_type", F.dayofmonth("ts").cast("string"))).alias("elements"))
    return similarity.set_join(u, 0.33).withColumn("similarity", r(F.col("similarity")))


# ---------------------------------------------------------------- overlap tests


@query("""WITH u AS (SELECT DISTINCT l_partkey AS x FROM lineitem), ref AS (SELECT DISTINCT l_partkey AS x FROM lineitem WHERE l_quantity >= 50), own AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS x FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT k, count(*) AS n, count(*) FILTER (x IN (SELECT x FROM ref)) AS a, (SELECT count(*) FROM ref) AS rf, (SELECT count(*) FROM u) AS un FROM own GROUP BY 1),
t AS (SELECT *, unnest(generate_series(greatest(a, n + rf - un), least(n, rf))) AS i FROM c),
p AS (SELECT k, sum(exp(lgamma(rf + 1) - lgamma(i + 1) - lgamma(rf - i + 1) + lgamma(un - rf + 1) - lgamma(n - i + 1) - lgamma(un - rf - n + i + 1) - lgamma(un + 1) + lgamma(n + 1) + lgamma(un - n + 1))) AS p FROM t GROUP BY 1)
SELECT c.k AS l_suppkey, n AS set_size, a AS hits, round(n * rf / un, 6) AS expected, round(least(1.0, p), 6) AS p FROM c JOIN p ON p.k = c.k""")
def fisher_overlap(spark, sf):
    i = load(spark, sf, "lineitem")
    out = evaluate.overlap(i.where("l_returnflag = 'R'"), i.where("l_quantity >= 50"), i, "l_suppkey", "l_partkey")
    return out.select("l_suppkey", "set_size", "hits", r(F.col("expected")).alias("expected"), r(F.col("p")).alias("p"))


def _binned(spark, sf) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select("p_brand", (F.col("p_size") / 10).cast("int").alias("bin"), (F.col("p_retailprice") > 1400).alias("chosen"), F.col("p_type").contains("STEEL").alias("marked"))


@query("""WITH g AS (SELECT p_brand, CAST(floor(p_size / 10) AS INTEGER) AS bin, count(*) FILTER (p_retailprice > 1400) AS k, count(*) FILTER (p_type LIKE '%STEEL%') AS m, count(*) AS n, count(*) FILTER (p_retailprice > 1400 AND p_type LIKE '%STEEL%') AS o FROM part GROUP BY 1, 2)
SELECT p_brand, CAST(sum(o) AS BIGINT) AS observed, round(sum(k * m / n), 6) AS mean, round(sum(CASE WHEN n > 1 THEN k * (m / n) * (1 - m / n) * (n - k) / (n - 1) ELSE 0.0 END), 6) AS variance FROM g GROUP BY 1""")
def binned_expected_overlap(spark, sf):
    return evaluate.binned_null(_binned(spark, sf), ["p_brand"], "bin", "chosen", "marked").select("p_brand", "observed", r(F.col("mean")).alias("mean"), r(F.col("variance")).alias("variance"))


@query()
def empirical_p(spark, sf):
    b = _binned(spark, sf)
    draws = evaluate.permutation_draws(b, ["p_brand"], "bin", "chosen", "marked", 200)
    seen = evaluate.binned_null(b, ["p_brand"], "bin", "chosen", "marked").select("p_brand", "observed")
    g = draws.join(seen, "p_brand").groupBy("p_brand", "observed").agg(F.sum((F.col("hits") >= F.col("observed")).cast("long")).alias("up"), F.sum((F.col("hits") <= F.col("observed")).cast("long")).alias("down"), F.count("*").alias("n"))
    return g.select("p_brand", "observed", stats.empirical_p(F.col("up"), F.col("n")).alias("p_up"), stats.empirical_p(F.col("down"), F.col("n")).alias("p_down"))


@query("""WITH RECURSIVE t AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS i, p FROM (SELECT p_brand, p_type, count(*) FILTER (p_size > 25) / count(*) AS p FROM part GROUP BY 1, 2)),
d AS (SELECT p_brand, CAST(0 AS BIGINT) AS i, [1.0::DOUBLE] AS x FROM (SELECT DISTINCT p_brand FROM part) UNION ALL
SELECT d.p_brand, t.i, list_transform(generate_series(1, len(x) + 1), lambda k: coalesce(x[k], 0) * (1 - p) + CASE WHEN k > 1 THEN x[k - 1] * p ELSE 0 END) FROM d JOIN t ON t.p_brand = d.p_brand AND t.i = d.i + 1)
SELECT p_brand, round(coalesce(list_sum(x[4:]), 0), 6) AS tail FROM (SELECT p_brand, arg_max(x, i) AS x FROM d GROUP BY 1)""")
def poisson_binomial_tail(spark, sf):
    p = load(spark, sf, "part").groupBy("p_brand", "p_type").agg((F.sum((F.col("p_size") > 25).cast("long")) / F.count("*")).alias("p"))
    g = p.groupBy("p_brand").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return g.select("p_brand", r(stats.poisson_binomial_tail(F.col("ps"), F.lit(3))).alias("tail"))


@query("""WITH p AS (SELECT l_suppkey, l_partkey, count(*) AS n, CAST(max(l_quantity) >= 45 AS INTEGER) AS hit FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, count(*) AS size, max(hit) AS hit FROM p GROUP BY 1),
z AS (SELECT size, count(*) AS n, sum(hit) AS h FROM s GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY abs(size - 560), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT CAST(sum(n) AS BIGINT) AS samples, CAST(sum(h) AS BIGINT) AS hits, round(sum(h) / sum(n), 6) AS rate FROM o WHERE before < 10""")
def size_matched_rate(spark, sf):
    i = load(spark, sf, "lineitem")
    s = i.groupBy("l_suppkey", "l_partkey").agg((F.max("l_quantity") >= 45).cast("int").alias("hit")).groupBy("l_suppkey").agg(F.count("*").alias("size"), F.max("hit").alias("hit"))
    return evaluate.size_matched(s, F.col("size"), 560, 10).withColumn("rate", r(F.col("rate")))


@query("SELECT v AS median FROM (SELECT p_size AS v, sum(count(*)) OVER (ORDER BY p_size) AS upto, sum(count(*)) OVER () AS n FROM part GROUP BY 1) WHERE upto * 2 >= n ORDER BY v LIMIT 1")
def weighted_lower_median(spark, sf):
    return evaluate.weighted_lower_median(load(spark, sf, "part"), "p_size")


# ---------------------------------------------------------------- scalar functions


@query("SELECT event_id, round(value * CASE event_type WHEN 'signup' THEN 1e-3 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 1e3 WHEN 'error' THEN 1e6 END, 6) AS nm FROM events")
def unit_conversion(spark, sf):
    e = load(spark, sf, "events")
    unit = F.when(F.col("event_type") == "signup", "pM").when(F.col("event_type") == "view", "nM").when(F.col("event_type") == "purchase", "uM").when(F.col("event_type") == "error", "mM").otherwise("furlong")
    return e.select("event_id", r(scalar.to_nm(F.col("value"), unit)).alias("nm"))


_RULES = [(r"copper|brass", "alloy"), (r"steel", "steel"), (r"^standard", "standard")]


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'copper|brass') THEN 'alloy' WHEN regexp_matches(lower(p_type), 'steel') THEN 'steel' WHEN regexp_matches(lower(p_type), '^standard') THEN 'standard' ELSE 'other' END AS kind FROM part")
def regex_classify(spark, sf):
    return load(spark, sf, "part").select("p_partkey", scalar.first_rule(F.col("p_type"), _RULES, "other").alias("kind"))


@query("SELECT p_partkey, 'infores:' || regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def source_slug(spark, sf):
    return load(spark, sf, "part").select("p_partkey", scalar.source_slug(F.col("p_name")).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")
def edge_year(spark, sf):
    o = load(spark, sf, "orders")
    date = F.when(F.col("o_orderpriority") == "5-LOW", "1970-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", scalar.edge_year(date).alias("year"))


@query("SELECT a.n_name AS word, string_agg(b.n_name, '|' ORDER BY levenshtein(lower(a.n_name), lower(b.n_name)), b.n_name) AS near FROM nation a JOIN nation b ON levenshtein(lower(a.n_name), lower(b.n_name)) <= 4 GROUP BY 1")
def levenshtein_suggest(spark, sf):
    n = load(spark, sf, "nation")
    names = n.agg(F.collect_list("n_name").alias("names"))  # 25 fixed names
    return n.join(F.broadcast(names)).select(F.col("n_name").alias("word"), F.array_join(scalar.suggestions(F.col("n_name"), F.col("names"), 4), "|").alias("near"))


@query("SELECT event_id, round(CASE WHEN value > 0 AND event_type <> 'error' THEN 9 - log10(value) END, 6) AS px FROM events")
def potency_transform(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", r(scalar.p_value_of(F.col("value"), F.when(F.col("event_type") == "error", ">"))).alias("px"))


@query("SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#', 1) AS prefix, regexp_extract(p_brand, '#(.*)$', 1) AS local FROM part")
def curie_parse(spark, sf):
    c = scalar.curie(F.regexp_replace("p_brand", "#", ":"))
    return load(spark, sf, "part").select("p_partkey", c["prefix"].alias("prefix"), c["local"].alias("local"))
