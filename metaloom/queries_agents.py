"""Queries for retrieval over a graph, assembly with its accounting, delimited sources and design statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar, stats
from .operators import ask, assemble, graph, studies, transforms, validate
from .operators.validate import NodeClass, Property
from .plans import metapath
from .queries import WITH_EDGES, WITH_GRAPH, query, r
from .sources import release
from .sources.graph_view import graph as star
from .sources.graph_view import load

# ---------------------------------------------------------------- retrieval


@query("""WITH m AS (SELECT DISTINCT p_type AS g, p_partkey AS id FROM part), d AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), s AS (SELECT g, count(*) AS size FROM m GROUP BY 1 HAVING count(*) <= 400), h AS (SELECT g, count(*) AS hits FROM m JOIN d USING (id) GROUP BY 1),
b AS (SELECT (SELECT count(*) FROM d) / count(DISTINCT p_partkey) AS density FROM part) SELECT g AS "group", size, hits, round(size * density, 6) AS expected, round(hits / (size * density), 6) AS ratio FROM s JOIN h USING (g), b""")
def virus_pathways(spark, sf):
    p, i = load(spark, sf, "part"), load(spark, sf, "lineitem")
    out = ask.virus_pathways(i.where("l_quantity = 50 and l_returnflag = 'R'").select(F.col("l_partkey").alias("id")), p.select(F.col("p_type").alias("group"), F.col("p_partkey").alias("id")), p.select(F.col("p_partkey").alias("id")), 400)
    return out.withColumn("expected", r(F.col("expected"))).withColumn("ratio", r(F.col("ratio")))


@query("""WITH x AS (SELECT l_partkey AS compound, l_suppkey % 4 AS virus, min(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS ic50, min(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS ki, min(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS kd FROM lineitem GROUP BY 1, 2)
SELECT compound, virus, coalesce(ic50, ki, kd) AS potency, CASE WHEN ic50 IS NOT NULL THEN 'ic50' WHEN ki IS NOT NULL THEN 'ki' ELSE 'kd' END AS field FROM x WHERE coalesce(ic50, ki, kd) IS NOT NULL""")
def best_potency(spark, sf):
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("compound"), (F.col("l_suppkey") % 4).alias("virus"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("ic50"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("ki"), F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("kd"))
    return ask.best_potency(e, ["compound", "virus"], ["ic50", "ki", "kd"])


@query("""SELECT l_partkey AS compound, l_suppkey % 4 AS virus, min(si) AS si_min, max(si) AS si_max, count(si) AS n, CASE WHEN min(si) > 0 THEN round(max(si) / min(si), 6) END AS spread, string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'O' END, '|') AS caution
FROM (SELECT *, CASE WHEN l_quantity > 2 THEN l_quantity END AS si FROM lineitem) GROUP BY 1, 2 HAVING count(si) > 0""")
def selectivity_notes(spark, sf):
    p = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("compound"), (F.col("l_suppkey") % 4).alias("virus"), F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("si"), F.col("l_linestatus").alias("cell"))
    return ask.selectivity_notes(p, ["compound", "virus"], ["O"]).withColumn("spread", r(F.col("spread")))


@query("SELECT p_partkey AS id, p_brand AS tier, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey)::INTEGER AS position, count(*) OVER (PARTITION BY p_brand) AS in_tier FROM part QUALIFY position <= 5")
def shortlist(spark, sf):
    return ask.shortlist(load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tier"), F.col("p_retailprice").alias("score")), "tier", "score", 5)


@query(WITH_EDGES + "SELECT subject || ' ' || lower(replace(predicate, '_', ' ')) || ' ' || object || ' [E' || substr(object, 3) || '].' AS sentence FROM edges WHERE predicate = 'LIVES_IN'")
def edge_sentences(spark, sf):
    e = star(spark, sf).edges.where("predicate = 'LIVES_IN'")
    return e.select(scalar.edge_sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.concat(F.lit("E"), F.substring("object", 3, 99))).alias("sentence"))


# ---------------------------------------------------------------- assembly

_LAYER_SQL = """n AS (SELECT 'chembl' AS layer, p_partkey AS id, CASE WHEN p_size > 25 THEN 'A' ELSE 'B' END AS class FROM part UNION ALL SELECT 'gtop', p_partkey, CASE WHEN p_size > 35 THEN 'A' ELSE 'B' END FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 'extra', p_partkey + 100000, 'C' FROM part WHERE p_partkey % 10 = 0),
e AS (SELECT DISTINCT 'chembl' AS layer, l_suppkey AS s, l_partkey AS o FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT DISTINCT 'gtop', l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 40)"""


def _layers(spark, sf):
    p, i = load(spark, sf, "part"), load(spark, sf, "lineitem")
    node = lambda df, key, cls: df.select(key.alias("id"), cls.alias("class"), F.col("p_type").alias("label"), F.col("p_partkey").alias("line_no"))
    edge = lambda df: df.select(F.col("l_suppkey").alias("subject"), F.lit("BINDS").alias("predicate"), F.col("l_partkey").alias("object")).distinct().select("*", F.lit("x").alias("source"), F.col("object").alias("line_no"))
    none = edge(i.where("false"))
    return {
        "gtop": (node(p.where("p_partkey % 3 > 0"), F.col("p_partkey"), F.when(F.col("p_size") > 35, "A").otherwise("B")), edge(i.where("l_quantity > 40"))),
        "chembl": (node(p, F.col("p_partkey"), F.when(F.col("p_size") > 25, "A").otherwise("B")), edge(i.where("l_returnflag <> 'N'"))),
        "extra": (node(p.where("p_partkey % 10 = 0"), F.col("p_partkey") + 100000, F.lit("C")), none),
    }


@query(f"""WITH {_LAYER_SQL}, c AS (SELECT id, class FROM n WHERE layer <> 'gtop'), x AS (SELECT n.layer, 'nodes' AS kind, CASE WHEN n.class <> c.class THEN 'rejected' WHEN layer = 'gtop' THEN 'merged' ELSE 'new' END AS fate FROM n JOIN c USING (id)
UNION ALL SELECT layer, 'edges', CASE WHEN layer = 'gtop' AND (s, o) IN (SELECT (s, o) FROM e WHERE layer = 'chembl') THEN 'merged' ELSE 'new' END FROM e)
SELECT layer, kind, count(*) AS rows, count(*) FILTER (fate = 'new') AS "new", count(*) FILTER (fate = 'merged') AS merged, count(*) FILTER (fate = 'rejected') AS rejected FROM x GROUP BY 1, 2""")
def assembly_accounting(spark, sf):
    return assemble.assemble(_layers(spark, sf), properties=["label"])[2]


@query(f"WITH {_LAYER_SQL} SELECT 'nodes' AS kind, (SELECT count(DISTINCT id) FROM n) AS n, 0 AS wrong UNION ALL SELECT 'edges', (SELECT count(*) FROM (SELECT DISTINCT s, o FROM e)), 0")
def assembly_reconciled(spark, sf):
    nodes, edges, fates = assemble.assemble(_layers(spark, sf), properties=["label"])
    wrong = assemble.reconcile(fates, nodes, edges).select("kind", F.lit(1).alias("w"))
    have = nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))
    return have.join(wrong, "kind", "left").select("kind", "n", F.coalesce("w", F.lit(0)).alias("wrong"))


@query("SELECT 0 AS collisions")
def fact_id_collisions(spark, sf):
    i = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().withColumn("edge_id", assemble.fact_id(F.col("l_suppkey"), F.col("l_partkey")))
    return assemble.id_collisions(i, ["l_suppkey", "l_partkey"]).agg(F.count("*").cast("int").alias("collisions"))


@query("SELECT 'ENUM' AS code, count(*) FILTER (p_size > 45) AS n FROM part UNION ALL SELECT 'MISSING_PROPERTY', count(*) FILTER (p_size % 9 = 0) FROM part")
def violation_report(spark, sf):
    nodes = load(spark, sf, "part").select(F.concat(F.lit("P:"), "p_partkey").alias("id"), F.lit("Part").alias("class"), F.when(F.col("p_size") > 45, "odd").otherwise("fine").alias("state"), F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("name"))
    kinds = [NodeClass("Part", ("P",), {"state": Property(values=("fine",)), "name": Property(required=True)})]
    return validate.report(validate.validate_nodes(nodes, kinds))


# ---------------------------------------------------------------- delimited sources


@query("""SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'P' || (10000 + l_suppkey) || '-PRO_' || l_partkey ELSE 'P' || (10000 + l_suppkey) END AS a, CASE WHEN l_linenumber % 3 > 0 THEN 'Q' || l_partkey END AS b, 'two hybrid' AS method, 1995 + l_linenumber AS year, CASE WHEN l_linenumber % 3 = 1 THEN concat(l_orderkey, '') END AS publication, l_suppkey AS taxon_a, -2 AS taxon_b, 'direct' AS type, 'db' AS source, round(l_discount, 2) AS score FROM lineitem WHERE l_orderkey % 9 = 0""")
def interaction_rows(spark, sf):
    i = load(spark, sf, "lineitem").where("l_orderkey % 9 = 0")
    a = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("uniprotkb:P"), F.col("l_suppkey") + 10000, F.lit("-PRO_"), "l_partkey")).otherwise(F.concat(F.lit("uniprotkb:P"), F.col("l_suppkey") + 10000))
    b = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("uniprotkb:Q"), "l_partkey")).otherwise(F.concat(F.lit("chebi:"), "l_partkey"))
    pub = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("pubmed:"), "l_orderkey")).otherwise("doi:1")
    cells = [a, b, F.lit("-"), F.lit("-"), F.lit("-"), F.lit("-"), F.lit('psi-mi:"MI:0018"(two hybrid)'), F.concat(F.lit("Smith J ("), F.col("l_linenumber") + 1995, F.lit(")")), pub, F.concat(F.lit("taxid:"), "l_suppkey", F.lit("(x)")), F.lit("taxid:-2"), F.lit('psi-mi:"MI:1"(direct)'), F.lit('psi-mi:"MI:2"(db)'), F.col("l_orderkey").cast("string"), F.concat(F.lit("score:"), F.col("l_discount").cast("string"))]
    rows = release.mitab(i.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")))
    return rows.withColumn("year", scalar.author_year(F.col("author"))).drop("author")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 4 = 1 THEN true WHEN o_orderkey % 4 = 2 THEN true ELSE false END AS dated, 'K' || lpad(concat(o_custkey, ''), 13, '0') AS skeleton, CASE WHEN o_orderkey % 2 = 0 THEN 'identical_key' ELSE 'shared_skeleton' END AS rule FROM orders")
def identity_rules(spark, sf):
    o = load(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 4 == 0, "soon").when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2020-13-45")
    key = F.concat(F.lit("K"), F.lpad(F.col("o_custkey").cast("string"), 13, "0"))
    a, b = F.concat(F.lit("X:"), key, F.lit("-A")), F.concat(F.lit("X:"), key, F.when(F.col("o_orderkey") % 2 == 0, "-A").otherwise("-B"))
    return o.select(F.col("o_orderkey").alias("id"), scalar.is_date_or_year(date).alias("dated"), scalar.skeleton(a).alias("skeleton"), scalar.same_rule(a, b).alias("rule"))


@query("SELECT p_partkey AS row, v AS violation FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_size % 6 = 0 THEN 'name' END], lambda x: x IS NOT NULL)) AS v FROM part)")
def curated_violations(spark, sf):
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("row"), "p_size", F.when(F.col("p_size") % 6 != 0, F.col("p_name")).alias("name"))
    return release.strict_rows(rows, {"size": F.col("p_size") <= 40, "name": F.col("name").isNotNull()})[1]


@query("SELECT 'S' || s_suppkey AS protein, s_name AS alias FROM supplier WHERE s_suppkey % 2 = 0")
def alias_table(spark, sf):
    s = load(spark, sf, "supplier")
    return release.aliases(s.select(F.concat_ws("\t", F.concat(F.lit("S"), "s_suppkey"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, "names").otherwise("codes")).alias("value")), "names")


@query("""WITH w AS (SELECT DISTINCT 'P' || lpad(concat(l_partkey % 700, ''), 5, '0') AS accession, l_partkey % 700 AS k FROM lineitem)
SELECT accession, CASE WHEN k < 200 THEN 'primary' WHEN k % 4 = 1 THEN 'secondary' WHEN k % 4 = 2 THEN 'demerged' WHEN k % 4 = 3 THEN 'deleted' ELSE 'unknown' END AS status, CASE WHEN k < 200 THEN accession WHEN k % 4 = 1 THEN 'H' || k END AS id FROM w""")
def accession_recovery(spark, sf):
    w = load(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.lpad((F.col("l_partkey") % 700).cast("string"), 5, "0")).alias("accession"), (F.col("l_partkey") % 700).alias("k")).distinct()
    one = w.where("k >= 200 and k % 4 in (1, 2)").select("accession", F.concat(F.lit("H"), "k").alias("primary"))
    two = w.where("k >= 200 and k % 4 = 2").select("accession", F.concat(F.lit("J"), "k").alias("primary"))
    return transforms.recover_accessions(w.select("accession"), w.where("k < 200"), one.unionByName(two), w.where("k % 4 = 3"))


# ---------------------------------------------------------------- design statistics


@query("SELECT 'least_expected' AS name, round(-ln(0.05), 6) AS value UNION ALL SELECT 'steps', 50.0 UNION ALL SELECT 'reach_m1', (SELECT count(*)::DOUBLE FROM supplier)")
def design_figures(spark, sf):
    g = star(spark, sf)
    path = metapath.parse("m", ["Supplier", "IN", "Nation"])
    pairs = metapath.reach(metapath.walk(g, path, graph.degree(g.edges))).select(F.lit("reach_m1").alias("name"), F.col("pairs").cast("double").alias("value"))
    rows = [("least_expected", round(stats.minimum_expected_hits(0.05), 6)), ("steps", float(stats.resolvable_steps(0.05, 999)))]
    return spark.createDataFrame(rows, "name string, value double").unionByName(pairs)


@query(WITH_GRAPH + """, w AS (SELECT 'M1' AS metapath, 'CONTAINS' AS p UNION ALL SELECT 'M1', 'LOST' UNION ALL SELECT 'M2', 'IN' UNION ALL SELECT 'M2', 'IN_REGION')
SELECT metapath, coalesce(string_agg(p, '|' ORDER BY p) FILTER (p NOT IN (SELECT predicate FROM edges)), '') AS missing FROM w GROUP BY 1""")
def absence_reasons(spark, sf):
    paths = [metapath.parse("M1", ["Order", "CONTAINS", "Part", "LOST", "Part"]), metapath.parse("M2", ["Supplier", "IN", "Nation", "IN_REGION", "Region"])]
    return metapath.missing_predicates(star(spark, sf), paths)


# ---------------------------------------------------------------- reach, coverage, indexes


@query(WITH_GRAPH + """, w AS (SELECT subject AS s, object AS p FROM edges WHERE predicate = 'PLACED'), f AS (SELECT subject AS p, object AS t FROM edges WHERE predicate = 'FROM'),
hub AS (SELECT id FROM degree WHERE degree > 9), big AS (SELECT id FROM nodes WHERE class = 'Order' AND id LIKE '%7'), x AS (SELECT 'as_is' AS setting, s, p, t FROM w JOIN f USING (p) UNION ALL SELECT 'hubs_off', s, p, t FROM w JOIN f USING (p) WHERE p NOT IN (SELECT id FROM hub)
UNION ALL SELECT 'cap_off', s, p, t FROM w JOIN f USING (p) WHERE p NOT IN (SELECT id FROM big) UNION ALL SELECT 'both_off', s, p, t FROM w JOIN f USING (p) WHERE p NOT IN (SELECT id FROM hub) AND p NOT IN (SELECT id FROM big))
SELECT setting, count(DISTINCT s) AS starts, count(DISTINCT t) AS ends, count(DISTINCT (s, t)) AS pairs, count(*) AS paths FROM x GROUP BY 1""")
def reach_settings(spark, sf):
    g = star(spark, sf)
    deg = graph.degree(g.edges)
    path = metapath.parse("m", ["Customer", "PLACED", "Order", "FROM", "Supplier"])
    return studies.reach_settings(g, path, deg, deg.where("degree > 9").select("id"), g.nodes.where("class = 'Order' and id like '%7'").select("id"))


@query("""WITH r AS (SELECT o_orderstatus AS file, o_custkey AS host, o_orderpriority AS method, o_orderkey AS line, o_totalprice > 100000 AS ok FROM orders), f AS (SELECT arg_min(file, line) AS file FROM r WHERE ok GROUP BY host, method), e AS (SELECT file, count(*) AS n FROM f GROUP BY 1)
SELECT r.file, count(*) AS rows, count(*) FILTER (ok) AS eligible, coalesce(any_value(n), 0) AS edges, count(*) FILTER (ok) - coalesce(any_value(n), 0) AS duplicates FROM r LEFT JOIN e ON e.file = r.file GROUP BY 1""")
def file_coverage(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_custkey").alias("host"), F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("line"), "o_totalprice")
    return studies.file_coverage(o, ["file"], F.col("o_totalprice") > 100000, ["host", "method"], ["line"])


@query("SELECT s_nationkey % 5 AS taxon, CASE WHEN s_suppkey % 3 > 0 THEN concat('F', s_suppkey % 3) END AS family, max(s_suppkey) AS id FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1, 2")
def viral_target_index(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("taxon_id"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("F"), F.col("s_suppkey") % 3)).alias("family"), F.col("s_suppkey").alias("ordinal"))
    taxa = load(spark, sf, "nation").select(F.col("n_nationkey").alias("any_taxon"), (F.col("n_nationkey") % 5).alias("taxon"))
    return studies.target_index(s, taxa)


@query("SELECT DISTINCT key FROM (SELECT concat(p_brand, p_size) AS key FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_type FROM part WHERE p_size > 30)")
def known_keys(spark, sf):
    p = load(spark, sf, "part")
    a = p.select(F.when(F.col("p_size") % 2 == 0, "M").otherwise("X").alias("class"), F.concat("p_brand", "p_size").alias("key"))
    return studies.known_keys([a, p.where("p_size > 30").select(F.lit("M").alias("class"), F.col("p_type").alias("key"))], "M", "key")


@query("SELECT lower(trim(s_name)) AS name, 'S:' || min(s_suppkey) AS id FROM supplier WHERE trim(s_name) <> '' GROUP BY 1 HAVING count(*) = 1")
def name_index(spark, sf):
    g = star(spark, sf)
    return studies.name_index(g.nodes.where("class = 'Supplier'"), load(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""SELECT r_name AS family, count(DISTINCT n_nationkey) AS organisms, (SELECT count(*) FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = r_regionkey) AS targets,
(SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey = r_regionkey AND c_acctbal < 0) AS screens FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def family_survey(spark, sf):
    n, g = load(spark, sf, "nation"), load(spark, sf, "region")
    organisms = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("family"), F.col("n_nationkey").alias("taxon"))
    return studies.family_survey(organisms, {"targets": load(spark, sf, "supplier").select(F.col("s_nationkey").alias("taxon")), "screens": load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("taxon"))})
