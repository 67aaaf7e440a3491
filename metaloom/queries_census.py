"""Queries for censuses and report operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import stats
from .operators import census, evaluate, graph, rank, similarity
from .queries import _BAL, _COS, _HITS, WITH_EDGES, WITH_GRAPH, _balances, _nearest, query, r
from .sources.graph_view import graph as star
from .sources.graph_view import load


@query(WITH_GRAPH + """, p AS (SELECT subject, predicate, object, count(*) AS m FROM edges GROUP BY 1, 2, 3), z AS (SELECT class, count(*) AS n FROM nodes GROUP BY 1)
SELECT predicate, s.class AS subject_class, o.class AS object_class, count(*) AS pairs, CAST(sum(m) AS BIGINT) AS edges, round(count(*) / (any_value(zs.n) * any_value(zo.n)), 9) AS density FROM p JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object JOIN z zs ON zs.class = s.class JOIN z zo ON zo.class = o.class GROUP BY 1, 2, 3""")
def density_census(spark, sf):
    return census.density(star(spark, sf)).withColumn("density", r(F.col("density"), 9))


@query(WITH_GRAPH + """, f AS (SELECT id, bool_or(predicate = 'CONTAINS') AS a, bool_or(predicate = 'FROM') AS b FROM nodes LEFT JOIN edges ON subject = id AND predicate IN ('CONTAINS', 'FROM') GROUP BY id)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'CONTAINS only' WHEN b THEN 'FROM only' ELSE 'neither' END AS part, count(*) AS n FROM f GROUP BY 1""")
def partition_census(spark, sf):
    g = star(spark, sf)
    return census.partition_census(g.nodes, g.edges, "CONTAINS", "FROM")


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'N') AS n_N, count(*) FILTER (l_returnflag = 'R') AS n_R FROM lineitem GROUP BY 1")
def direction_pivot(spark, sf):
    return census.pivot_counts(load(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query(WITH_GRAPH + """, h0 AS (SELECT id FROM nodes WHERE class = 'Customer'), h1 AS (SELECT DISTINCT object AS id FROM edges WHERE predicate = 'PLACED' AND subject IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT object AS id FROM edges WHERE predicate = 'FROM' AND subject IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT object AS id FROM edges WHERE predicate = 'IN' AND subject IN (SELECT id FROM h2))
SELECT 0 AS hop, '' AS predicate, count(*) AS reached FROM h0 UNION ALL SELECT 1, 'PLACED', count(*) FROM h1 UNION ALL SELECT 2, 'FROM', count(*) FROM h2 UNION ALL SELECT 3, 'IN', count(*) FROM h3""")
def hop_attrition(spark, sf):
    return census.hop_attrition(star(spark, sf), "Customer", ["PLACED", "FROM", "IN"])


@query("""WITH o AS (SELECT p_partkey AS id, p_brand AS key FROM part WHERE p_size <= 5), ref AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), t AS (SELECT DISTINCT p_brand AS key FROM part WHERE p_size = 50 AND p_retailprice > 1900)
SELECT id, CASE WHEN id IN (SELECT id FROM ref) THEN 'dropped_at_assembly' WHEN key IN (SELECT key FROM t) THEN 'discarded_identifier' ELSE 'never_referenced' END AS reason FROM o""")
def orphan_diagnosis(spark, sf):
    p = load(spark, sf, "part")
    e = load(spark, sf, "lineitem").where("l_quantity = 50 and l_returnflag = 'R'").select(F.col("l_partkey").alias("subject"), F.col("l_partkey").alias("object"))
    sib = p.select(F.col("p_brand").alias("key"), ((F.col("p_size") == 50) & (F.col("p_retailprice") > 1900)).alias("touched"))
    return census.orphan_diagnosis(p.where("p_size <= 5").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key")), e, sib)


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS s, exp(-abs(c_acctbal) / 900) AS p FROM customer)
SELECT 'all' AS family, count(*) AS tests, round(0.05 / count(*), 9) AS threshold, count(*) FILTER (p <= 0.05 / (SELECT count(*) FROM t)) AS survivors FROM t
UNION ALL SELECT 'building', count(*), round(0.05 / count(*), 9), count(*) FILTER (p <= 0.05 / (SELECT count(*) FROM t WHERE s = 'BUILDING')) FROM t WHERE s = 'BUILDING'""")
def correction_families(spark, sf):
    t = load(spark, sf, "customer").select("c_mktsegment", F.exp(-F.abs("c_acctbal") / 900).alias("p"))
    return census.correction_families(t, 0.05, {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING"}).withColumn("threshold", r(F.col("threshold"), 9))


@query(f"""WITH h AS ({_HITS}), l AS (SELECT c_nationkey, hits_min / (positives * least(10, pool) / pool) AS a, hits_max / (positives * least(10, pool) / pool) AS b FROM h WHERE positives > 0), base AS (SELECT a AS ba, b AS bb FROM l WHERE c_nationkey = 0)
SELECT c_nationkey, CASE WHEN a <= bb AND b >= ba AND a < b THEN 'undetermined' WHEN a > bb THEN 'above_baseline' WHEN b < ba THEN 'confounded' ELSE 'at_baseline' END AS reading FROM l, base""")
def baseline_reading(spark, sf):
    lifts = evaluate.lift(_balances(spark, sf), "positive", ["c_nationkey"], 10).where("positives > 0").withColumn("all", F.lit(1))
    return census.against_baseline(lifts, lifts.where("c_nationkey = 0"), ["all"]).select("c_nationkey", "reading")


@query(f"""WITH {_COS}, x AS (SELECT query, list(s ORDER BY s) AS x, count(*) AS n FROM other WHERE rk <= 20 GROUP BY 1),
q AS (SELECT query, n, x, unnest([0.5, 0.75, 0.9]) AS p FROM x), w AS (SELECT *, greatest(1.0, least(n, p * (n + 1))) AS pos FROM q), v AS (SELECT query, n, p, x[CAST(floor(pos) AS INTEGER)] AS a, x[CAST(least(floor(pos) + 1, n) AS INTEGER)] AS b, pos - floor(pos) AS f FROM w)
SELECT query, n, round(max(a + (b - a) * f) FILTER (p = 0.5), 6) AS median, round(max(a + (b - a) * f) FILTER (p = 0.75), 6) AS p75, round(max(a + (b - a) * f) FILTER (p = 0.9), 6) AS p90 FROM v GROUP BY 1, 2""")
def resemblance_floor(spark, sf):
    out = census.resemblance_floor(_nearest(spark, sf, 20), "query")
    return out.select("query", "n", *[r(F.col(c)).alias(c) for c in ("median", "p75", "p90")])


@query(WITH_GRAPH + """, d AS (SELECT c_custkey AS id, CAST(abs(c_acctbal) / 1000 AS INTEGER) AS distance, c_mktsegment AS bin, c_nationkey AS grp FROM customer), pool AS (SELECT bin, avg(distance) AS mu, var_pop(distance) AS v FROM d GROUP BY 1),
g AS (SELECT grp, avg(distance) AS mean, avg(mu) AS expected, sqrt(sum(v)) / count(*) AS sd FROM d JOIN pool USING (bin) GROUP BY 1) SELECT grp, round(mean, 6) AS mean, round(expected, 6) AS expected, round(CASE WHEN sd > 0 THEN -(mean - expected) / sd END, 6) AS z FROM g""")
def proximity_expectation(spark, sf):
    c = load(spark, sf, "customer").withColumn("distance", F.round(F.abs("c_acctbal") / 1000).cast("int"))
    d = c.select(F.col("c_custkey").alias("id"), "distance")
    out = census.proximity(d, c.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("bin")), "grp")
    return out.select("grp", *[r(F.col(x)).alias(x) for x in ("mean", "expected", "z")])


@query("SELECT l_quantity AS bound, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def bound_census(spark, sf):
    i = load(spark, sf, "lineitem")
    return census.bound_census(i.select(F.when(F.col("l_returnflag") == "R", ">").otherwise("=").alias("relation"), F.col("l_quantity").alias("nm")))


@query(f"WITH {_BAL}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS INTEGER) AS position FROM bal) SELECT c_custkey, position, position > 20 AS displaced FROM t")
def top_per_tier(spark, sf):
    return census.top_per_tier(_balances(spark, sf), "c_nationkey", [F.desc("score"), F.asc("c_custkey")], 20).select("c_custkey", "position", "displaced")


@query("""WITH a AS (SELECT o_custkey AS path, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY 1), b AS (SELECT o_custkey AS path, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) > 1996 GROUP BY 1)
SELECT path, a.v AS before, b.v AS after FROM a FULL JOIN b USING (path) WHERE a.v IS DISTINCT FROM b.v""")
def flattened_diff(spark, sf):
    o = load(spark, sf, "orders").withColumn("late", F.year("o_orderdate") > 1996)
    side = lambda late: o.where(F.col("late") == late).groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderpriority").alias("value"))
    return census.flattened_diff(side(False), side(True))


@query("""WITH p AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (l_quantity = 50) AS h FROM lineitem GROUP BY 1)
SELECT k AS l_suppkey, CASE WHEN n * 0.02 < 3 AND h = 0 THEN 'refused_unpowered' WHEN h > n * 0.025 THEN 'enriched' WHEN h < n * 0.015 THEN 'depleted' ELSE 'at_null' END AS verdict FROM p""")
def landscape_verdicts(spark, sf):
    p = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"), F.countDistinct(F.when(F.col("l_quantity") == 50, F.col("l_partkey"))).alias("hits"))
    x = p.select("l_suppkey", "hits", (F.col("n") * 0.02).alias("expected"), F.when(F.col("hits") > F.col("n") * 0.025, 0.0).otherwise(1.0).alias("p_up"), F.when(F.col("hits") < F.col("n") * 0.015, 0.0).otherwise(1.0).alias("p_down"), F.lit(True).alias("resolvable"))
    return census.landscape_verdicts(x, 0.05, stats.minimum_expected_hits(0.05)).select("l_suppkey", "verdict")


@query(WITH_EDGES + "SELECT subject_degree, count(*) AS n FROM (SELECT subject, count(DISTINCT object) AS subject_degree FROM edges WHERE predicate = 'CONTAINS' GROUP BY 1) GROUP BY 1")
def distinct_target_census(spark, sf):
    e = star(spark, sf).edges.where("predicate = 'CONTAINS'").select("subject", "object").distinct()
    return e.groupBy("subject").agg(F.count("*").alias("subject_degree")).groupBy("subject_degree").agg(F.count("*").alias("n"))


@query(f"WITH {_BAL}, t AS (SELECT c_nationkey, score, count(*) AS n FROM bal GROUP BY 1, 2 HAVING count(*) > 1) SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS tied FROM t GROUP BY 1")
def tie_census(spark, sf):
    at = rank.value_positions(_balances(spark, sf), "score", ["c_nationkey"])
    return at.where("c > 1").groupBy("c_nationkey").agg(F.sum("c").alias("tied"))


@query(f"WITH {_COS} SELECT query, max_by(reference, s) AS reference, round(max(s), 6) AS similarity FROM other WHERE rk = 1 GROUP BY 1")
def max_similarity(spark, sf):
    return _nearest(spark, sf, 1).select("query", "reference", r(F.col("similarity")).alias("similarity"))


@query("SELECT user_id, session_start, session_end, n FROM (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s)")
def event_sessions(spark, sf):
    from .streaming.events import sessions

    return sessions(load(spark, sf, "events"))


@query(WITH_GRAPH + "SELECT c.degree AS degree, count(*) AS n FROM degree c GROUP BY 1")
def degree_histogram(spark, sf):
    return graph.degree(star(spark, sf).edges).groupBy("degree").agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT user_id, list(DISTINCT event_type) AS e FROM events GROUP BY 1) SELECT len(e) AS size, count(*) AS n FROM u GROUP BY 1")
def profile_sizes(spark, sf):
    u = load(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").cast("long").alias("size"))
    return u.groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT q.vec_id AS query, round(avg(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS mean FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1")
def mean_similarity(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = similarity.query_join(v.where(F.col("id") % 100 == 0), v, similarity.cosine, 1_000_000_000)
    return out.groupBy("query").agg(r(F.avg("similarity")).alias("mean"))
