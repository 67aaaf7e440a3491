"""Queries for per-source transforms, identifier recovery, retrieval and release operators, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import ask, assemble, graph, temporal, transforms
from .queries import WITH_EDGES, WITH_GRAPH, query, r
from .sources import release
from .sources.graph_view import graph as star
from .sources.graph_view import load


def _readings(spark, sf):
    i = load(spark, sf, "lineitem")
    cols = [F.col("l_partkey").alias("compound"), (F.col("l_orderkey") % 50).alias("document"), F.col("l_returnflag").alias("cell"), F.col("l_quantity").alias("nm")]
    act = i.where("l_linestatus = 'O'").select(*cols, (F.col("l_suppkey") % 3).alias("virus"))
    tox = i.where("l_linestatus = 'F'").select(*cols[:3], (F.col("l_quantity") * 20).alias("nm"), (F.col("l_discount") > 0.05).alias("exact"))
    return act, tox


_PAIRS = """act AS (SELECT l_partkey AS compound, l_orderkey % 50 AS document, l_returnflag AS cell, l_quantity AS nm, l_suppkey % 3 AS virus FROM lineitem WHERE l_linestatus = 'O'),
tox AS (SELECT l_partkey AS compound, l_orderkey % 50 AS document, l_returnflag AS cell, l_quantity * 20 AS nm, l_discount > 0.05 AS exact FROM lineitem WHERE l_linestatus = 'F'),
t AS (SELECT compound, document, bool_or(exact) AS exact, arg_min((nm, cell), (NOT exact, nm, cell))[1] AS cc50, arg_min((nm, cell), (NOT exact, nm, cell))[2] AS cell FROM tox GROUP BY 1, 2),
pairs AS (SELECT a.compound, a.document, a.virus, t.cc50, coalesce(max(a.nm) FILTER (a.cell = t.cell), max(a.nm)) AS ec50, t.exact FROM act a JOIN t ON t.compound = a.compound AND t.document = a.document GROUP BY a.compound, a.document, a.virus, t.cc50, t.cell, t.exact),
si AS (SELECT *, CASE WHEN cc50 > 0 AND ec50 > 0 THEN cc50 / ec50 END AS si FROM pairs)"""


@query(f"WITH {_PAIRS} SELECT compound, document, virus, cc50, ec50, exact, round(si, 6) AS si FROM si")
def selectivity_pairs(spark, sf):
    return transforms.selectivity_pairs(*_readings(spark, sf)).withColumn("si", r(F.col("si")))


@query(f"WITH {_PAIRS} SELECT compound, virus, round(coalesce(median(si) FILTER (exact), max(si) FILTER (NOT exact)), 6) AS si, round(max(si), 6) AS si_max, count(*) AS n FROM si WHERE si IS NOT NULL AND (exact OR si >= 10) GROUP BY 1, 2")
def selectivity_summary(spark, sf):
    out = transforms.selectivity_summary(transforms.selectivity_pairs(*_readings(spark, sf)))
    return out.select("compound", "virus", r(F.col("si")).alias("si"), r(F.col("si_max")).alias("si_max"), "n")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 'no_response' WHEN l_linenumber = 7 OR l_discount = 0 THEN 'no_fit' WHEN l_returnflag = 'A' THEN 'cytotoxic' WHEN NOT l_quantity * (CASE WHEN l_linestatus = 'O' THEN 3 ELSE -3 END) >= 50 THEN 'weak' WHEN l_discount * 200 <= 10 THEN 'active' ELSE 'below_threshold' END AS reason,
CASE WHEN l_linenumber = 4 THEN false WHEN l_linenumber = 7 OR l_discount = 0 OR l_returnflag = 'A' OR NOT l_quantity * (CASE WHEN l_linestatus = 'O' THEN 3 ELSE -3 END) >= 50 THEN NULL WHEN l_discount * 200 <= 10 THEN true END AS active FROM lineitem""")
def screen_verdicts(spark, sf):
    i = load(spark, sf, "lineitem")
    v = transforms.screen_verdict(F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")), F.col("l_quantity"), F.when(F.col("l_linestatus") == "O", 3).otherwise(-3), F.when(F.col("l_discount") != 0, F.col("l_discount") * 200), F.col("l_returnflag") == "A", F.lit(50.0))
    return i.select("l_orderkey", "l_linenumber", v["reason"].alias("reason"), v["active"].alias("active"))


@query("""WITH x AS (SELECT l_partkey, l_quantity > 25 AS active, l_quantity AS v, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_partkey, bool_or(active) AS active, bool_or(active) AND bool_or(NOT active) AS disagree, arg_min(v, (NOT active, o)) AS value_um FROM x GROUP BY 1""")
def replicate_collapse(spark, sf):
    i = load(spark, sf, "lineitem")
    rows = i.select("l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity") > 25).alias("active"), F.col("l_quantity").alias("value_um"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return transforms.collapse_replicates(rows, ["l_partkey"])


@query("WITH x AS (SELECT l_suppkey AS screen, sum(sign(l_quantity - 25) * CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END) AS s FROM lineitem WHERE l_partkey <= 150 GROUP BY 1) SELECT DISTINCT l_suppkey AS screen, CAST(coalesce(sign(s), 0) AS INTEGER) AS sign FROM lineitem LEFT JOIN x ON screen = l_suppkey")
def screen_sign_calibration(spark, sf):
    s = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("screen"), F.col("l_partkey").alias("gene"), (F.col("l_quantity") - 25).alias("score"))
    anchors = load(spark, sf, "part").where("p_partkey <= 150").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("expected"))
    return transforms.sign_by_anchors(s, anchors, ["screen"])


@query("SELECT CASE WHEN l_partkey % 7 = 0 THEN 'identifier' WHEN (l_linestatus = 'O') = (l_returnflag = 'N') THEN 'same_side' WHEN l_linenumber = 3 THEN 'method' WHEN l_tax = 0 THEN 'publication' ELSE 'kept' END AS gate, count(*) AS n FROM lineitem GROUP BY 1")
def interaction_gates(spark, sf):
    i = load(spark, sf, "lineitem")
    gate = transforms.interaction_gate(F.col("l_linestatus") == "O", F.col("l_returnflag") == "N", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")), F.col("l_suppkey"), F.when(F.col("l_linenumber") == 3, "Inference").otherwise("two hybrid"), F.when(F.col("l_tax") != 0, F.col("l_tax")), ["inference"])
    return i.groupBy(F.coalesce(gate, F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS l_returnflag, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS l_quantity FROM lineitem GROUP BY 1, 2")
def interaction_dedupe(spark, sf):
    i = load(spark, sf, "lineitem")
    return transforms.first_of(i.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, arg_min(s, o) AS score FROM (SELECT l_partkey AS a, l_suppkey AS b, l_quantity AS s, l_orderkey * 10 + l_linenumber AS o FROM lineitem) WHERE s >= 20 AND a <> b GROUP BY 1, 2")
def undirected_links(spark, sf):
    i = load(spark, sf, "lineitem")
    return release.undirected_links(i.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")), "score", 20)


@query("""WITH g AS (SELECT l_partkey AS compound, l_suppkey AS disease, max(l_linenumber) AS phase, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_orderkey END) AS reference FROM lineitem GROUP BY 1, 2)
SELECT *, CASE WHEN phase >= 4 THEN 'TREATS' ELSE 'IN_TRIAL_FOR' END AS predicate FROM g WHERE phase >= 4 OR reference IS NOT NULL""")
def indication_collapse(spark, sf):
    i = load(spark, sf, "lineitem")
    return transforms.collapse_indications(i.select(F.col("l_partkey").alias("compound"), F.col("l_suppkey").alias("disease"), F.col("l_linenumber").alias("phase"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.col("l_orderkey").cast("string"))).alias("registry_id")))


@query("""SELECT l_partkey AS compound, l_suppkey AS target, l_returnflag AS type, arg_min(l_linestatus, (l_orderkey * 10 + l_linenumber, l_linestatus)) AS action, CAST(min(year(l_shipdate)) AS INTEGER) AS year, min(l_quantity) AS potency_min_nm, max(l_quantity) AS potency_max_nm, count(*) AS potency_rows FROM lineitem GROUP BY 1, 2, 3""")
def target_edge_collapse(spark, sf):
    i = load(spark, sf, "lineitem")
    rows = i.select(F.col("l_partkey").alias("compound"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("action"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.year("l_shipdate").alias("year"), F.lit("p").alias("publication"), F.col("l_quantity").alias("nm"))
    return transforms.collapse_targets(rows).drop("publications")


@query("SELECT p_brand, CASE WHEN count(DISTINCT p_size > 2) = 1 THEN min(CASE WHEN p_size > 2 THEN 'large' ELSE 'small' END) ELSE 'unknown' END AS kind FROM part GROUP BY 1")
def unanimous_class(spark, sf):
    return transforms.unanimous(load(spark, sf, "part").select("p_brand", F.when(F.col("p_size") > 2, "large").otherwise("small").alias("kind")), "p_brand", "kind")


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'y' END AS role, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'unknown' ELSE 'serine' END AS t, p_brand || '/' || p_size AS fold FROM part),
p AS (SELECT a.id AS a, b.id AS b, a.role AS ra, b.role AS rb, a.t AS ta, b.t AS tb, a.fold AS shared FROM c a JOIN c b ON a.fold = b.fold AND a.id < b.id),
m AS (SELECT *, CASE WHEN ra <> rb THEN 'role_differs' WHEN ta = 'unknown' OR tb = 'unknown' THEN 'unknown_chemistry' WHEN (ta = 'none') <> (tb = 'none') THEN 'one_sided' WHEN ta = 'none' THEN 'fold_only' WHEN ta = tb THEN 'catalytic' ELSE 'types_differ' END AS mode FROM p)
SELECT a, b, mode IN ('fold_only', 'catalytic') AS allowed, mode, CASE mode WHEN 'catalytic' THEN 'strong' WHEN 'fold_only' THEN 'weak' END AS strength, shared FROM m""")
def fold_pair_gate(spark, sf):
    p = load(spark, sf, "part")
    t = F.when(F.col("p_size") % 4 == 0, "none").when(F.col("p_size") % 4 == 1, "unknown").otherwise("serine")
    return transforms.fold_pairs(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "x").otherwise("y").alias("role"), t.alias("catalytic_type"), F.array(F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))).alias("folds")))


@query("""WITH n AS (SELECT 'P:' || p_partkey AS id, 'K' || p_partkey AS key, p_name AS external FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT o_orderkey AS row, 'K' || (o_orderkey % 2500) AS key FROM orders), u AS (SELECT key AS sk, min(id) AS b FROM n GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT row, coalesce(n.id, u.b) AS id, CASE WHEN n.id IS NOT NULL THEN 'exact' WHEN u.b IS NOT NULL THEN 'skeleton' ELSE 'absent' END AS route FROM w LEFT JOIN n ON n.key = w.key LEFT JOIN u ON u.sk = w.key""")
def compound_resolution(spark, sf):
    n = load(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("external"))
    w = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.concat(F.lit("K"), (F.col("o_orderkey") % 2500).cast("string")).alias("key"), F.lit(None).cast("string").alias("external"))
    return transforms.resolve_compounds(w, n).select("row", "id", "route")


@query("WITH g AS (SELECT upper(p_brand) AS u, count(DISTINCT p_size) AS n, min(p_size) AS i FROM part WHERE p_size < 3 GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN i END AS id FROM part LEFT JOIN g ON u = upper(p_brand)")
def symbol_resolution(spark, sf):
    p = load(spark, sf, "part")
    return transforms.resolve_symbols(p.select("p_partkey", F.lower("p_brand").alias("symbol")), p.where("p_size < 3").select(F.col("p_brand").alias("symbol"), F.col("p_size").alias("id"))).drop("symbol")


@query("WITH x AS (SELECT l_suppkey AS accession, lower(l_returnflag || '-' || l_partkey % 40) AS label, l_partkey AS chain, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT label, arg_min(accession, (-n, accession, chain)) AS accession, arg_min(chain, (-n, accession, chain)) AS chain FROM x GROUP BY 1")
def richest_entry_first(spark, sf):
    i = load(spark, sf, "lineitem")
    return transforms.richest_first(i.select(F.col("l_suppkey").alias("accession"), F.concat_ws("-", "l_returnflag", (F.col("l_partkey") % 40).cast("string")).alias("label"), F.col("l_partkey").alias("chain")))


@query("""WITH m AS (SELECT DISTINCT p_brand || p_size AS grp, p_partkey AS id FROM part), t AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50), k AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.1),
s AS (SELECT grp, count(*) AS size, count(*) FILTER (id IN (SELECT id FROM t)) AS targets, count(*) FILTER (id IN (SELECT id FROM k)) AS hits FROM m GROUP BY 1)
SELECT grp AS "group", size, targets, hits, round(size * (SELECT count(*) FROM k) / 2000, 6) AS expected, round(CASE WHEN (SELECT count(*) FROM k) > 0 THEN hits / (size * (SELECT count(*) FROM k) / 2000) END, 6) AS ratio FROM s WHERE size <= 3 AND targets > 0""")
def pathway_density(spark, sf):
    i = load(spark, sf, "lineitem")
    m = load(spark, sf, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("group"), F.col("p_partkey").alias("id"))
    out = ask.shared_groups(m, i.where("l_quantity = 50").select(F.col("l_partkey").alias("id")), i.where("l_tax = 0.08 and l_discount = 0.1").select(F.col("l_partkey").alias("id")), 2000, 3)
    return out.select("group", "size", "targets", "hits", r(F.col("expected")).alias("expected"), r(F.col("ratio")).alias("ratio"))


@query("WITH d AS (SELECT l_partkey AS id, min(l_quantity) AS potency FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS si FROM part WHERE p_size > 10) SELECT p_partkey AS id, potency IS NOT NULL AS direct, si, potency FROM part LEFT JOIN d ON d.id = p_partkey LEFT JOIN s ON s.id = p_partkey")
def triage(spark, sf):
    p = load(spark, sf, "part")
    direct = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("nm"))
    return ask.triage(p.select(F.col("p_partkey").alias("id")), direct, p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("si")))


@query("SELECT id, name, match FROM (SELECT n_nationkey AS id, n_name AS name, 'part' AS match FROM nation WHERE lower(n_name) LIKE '%a%') ORDER BY length(name), name, id LIMIT 5")
def resolve_name(spark, sf):
    return ask.resolve(load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "a")


@query(WITH_EDGES + "SELECT predicate, object, qualifier FROM edges WHERE subject = 'O:7' ORDER BY predicate, object, qualifier, year LIMIT 25")
def evidence_lookup(spark, sf):
    return ask.evidence(star(spark, sf).edges, "O:7").select("predicate", "object", "qualifier")


@query(WITH_GRAPH + """, x AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degree)
SELECT 'class' AS section, class AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'degree', p, degree FROM x JOIN (VALUES ('p50', 50.0), ('p99', 99.0), ('p99.9', 99.9), ('max', 100.0)) v(p, q) ON i = least(CAST(floor(x.n * q / 100) AS BIGINT), x.n - 1)""")
def release_manifest(spark, sf):
    g = star(spark, sf)
    return release.manifest(g.nodes, g.edges)


@query("SELECT l_orderkey, l_linenumber, 'E' || substr(sha256(l_suppkey || chr(31) || l_partkey || chr(31)), 1, 16) AS edge_id FROM lineitem")
def fact_ids(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", assemble.fact_id(F.col("l_suppkey"), F.col("l_partkey"), F.lit(None)).alias("edge_id"))


@query("WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END AS class FROM part UNION ALL SELECT l_partkey, CASE WHEN l_tax > 0.04 THEN 'A' ELSE 'B' END FROM lineitem) SELECT id, string_agg(DISTINCT class, '|' ORDER BY class) AS classes FROM x GROUP BY 1 HAVING count(DISTINCT class) > 1")
def class_conflicts(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "A").otherwise("B").alias("class"))
    i = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_tax") > 0.04, "A").otherwise("B").alias("class"))
    return assemble.class_conflicts(p.unionByName(i))


@query("SELECT o_orderkey, regexp_matches(lower(o_orderpriority), '(?:^|[^a-z0-9])low(?:[^a-z0-9]|$)') AS mentioned, CASE WHEN o_orderkey % 5 = 4 THEN 'approved' WHEN o_orderkey % 5 >= 1 THEN 'clinical' ELSE 'research' END AS tier FROM orders")
def mention_and_tier(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", scalar.mentions(F.col("o_orderpriority"), "low").alias("mentioned"), scalar.phase_tier(F.col("o_orderkey") % 5).alias("tier"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS computed FROM orders")
def computed_sources(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", scalar.computed_only(F.col("o_orderstatus"), ["F", "P"]).alias("computed"))


@query(WITH_EDGES + "SELECT CASE WHEN predicate = 'PLACED' THEN 'held_out' ELSE predicate END AS predicate, CAST(count(*) AS BIGINT) AS n FROM edges WHERE predicate <> 'PLACED' AND coalesce(year <= 1997, false) GROUP BY 1")
def undated_excluded(spark, sf):
    return temporal.training_edges(star(spark, sf).edges, 1997, ["PLACED"], "exclude").groupBy("predicate").agg(F.count("*").alias("n"))


@query(WITH_GRAPH + "SELECT class, count(*) AS n, CAST(sum(coalesce(degree, 0)) AS BIGINT) AS incident FROM nodes LEFT JOIN degree USING (id) GROUP BY 1")
def incident_by_class(spark, sf):
    g = star(spark, sf)
    return g.nodes.join(graph.degree(g.edges), "id", "left").groupBy("class").agg(F.count("*").alias("n"), F.sum(F.coalesce("degree", F.lit(0))).alias("incident"))
