"""Plans, declared documents, proteomes, assembly, splits and refusals on small fixtures."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

import metaloom.queries_agents  # noqa: F401
import metaloom.queries_relational  # noqa: F401
import metaloom.queries_sources  # noqa: F401
from metaloom.functions import texts
from metaloom.operators import assemble, graph, rank, relational, screens, studies, temporal
from metaloom.queries import QUERIES
from metaloom.sources import declared, proteome, release
from metaloom.sources.assay_view import assays
from metaloom.sources.graph_view import Graph

SF = "/root/testdata/sf0.001"


def counts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange")


def test_plans_stay_flat(spark):
    scans, exchanges = counts(QUERIES["bfs_distance"](spark, SF))
    assert scans <= 5 and exchanges <= 2
    assert counts(QUERIES["metapath_dwpc_m1"](spark, SF))[0] <= 16
    scans, exchanges = counts(QUERIES["release_manifest"](spark, SF))
    assert scans <= 30 and exchanges <= 12


def test_bins_and_ranks_count_values_over_many_partitions(spark):
    rows = [(g, i * 37 % 101 // (1 + g), i) for g in range(3) for i in range(100 * (g + 1))]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(7)
    got = {(r.g, r.i): r.bin for r in rank.equal_count_bins(df, ["g"], ["v", "i"], 7).collect()}
    ranks = {(r.g, r.i): r.avg_rank for r in rank.average_rank(df, "v", ["g"]).collect()}
    for g in range(3):
        own = sorted((v, i) for k, v, i in rows if k == g)
        assert all(got[g, i] == min(6, at * 7 // len(own)) for at, (_, i) in enumerate(own))
        assert all(ranks[g, i] == sum(x < v for x, _ in own) + (sum(x == v for x, _ in own) + 1) / 2 for v, i in own)


def test_no_taxa_is_refused(spark):
    with pytest.raises(ValueError):
        relational.activity_scan(assays(spark, SF), [])


REGISTER = {
    "defaults": {"family": "Coronaviridae"},
    "viruses": [
        {"name": "ok", "taxon": 1, "isolate_taxa": [2], "chain_source": {"taxon": 2, "accession": "A1", "chains": 3}, "mondo": None},
        {"name": "twice", "taxon": 1, "isolate_taxa": [1], "chain_source": {"taxon": 9, "accession": "A2", "chains": 0}, "family": "F", "ppi_accession_map": {"A2": "A2", "X": "Y"}},
        {"name": "none", "taxon": None},
    ],
    "surveyed": [{"name": "bare", "taxon": 5, "mondo": "M"}, {"name": "half", "taxon": 6, "chain_source": {"taxon": 6}, "mondo": "M"}],
}


def test_register_and_schema_documents(spark, tmp_path):
    path = tmp_path / "register.json"
    path.write_text(json.dumps(REGISTER))
    entries = declared.register_entries(spark, declared.load_document(spark, str(path)))
    assert {r.name: r.family for r in entries.collect()}["ok"] == "Coronaviridae"
    got = {}
    for r in declared.validate_register(entries).collect():
        got.setdefault(r.name, set()).add(r.violation)
    assert got == {
        "twice": {"DUPLICATE_TAXON", "ISOLATE_IS_SPECIES", "UNDECLARED_CHAIN_TAXON", "NO_CHAINS", "PPI_MAP_SELF", "PPI_MAP_TARGET_NOT_CARRIED", "PPI_MAP_SOURCE_IS_CARRIED", "PPI_MAP_UNEXPLAINED", "MONDO_UNSTATED"},
        "none": {"NO_TAXON"},
        "bare": {"NO_CHAIN_SOURCE"},
        "half": {"INCOMPLETE_CHAIN_SOURCE"},
    }
    doc = {"node_classes": {"Protein": {"prefixes": ["UniProtKB"], "properties": {"reviewed": {"required": True}}}}, "edge_classes": [{"subject": "Protein", "predicate": "TREATS", "object": "Protein", "evaluation_label": True}]}
    nodes, edges, labels = declared.schema_of(doc)
    assert nodes[0].properties["reviewed"].required and edges[0].predicate == "TREATS" and labels == {"TREATS"}
    moves = spark.createDataFrame([({"X": "A"},), ({"X": "B"},)], "moved map<string,string>")
    with pytest.raises(Exception, match="attributed twice"):
        declared.accession_moves(moves).collect()


def entry(acc, **more):
    return {"primaryAccession": acc, "genes": [{"geneName": {"value": f"G{acc}"}}], "sequence": {"value": "MK"}} | more


def test_proteome_documents(spark, tmp_path):
    ref = lambda db, i, **p: {"database": db, "id": i, "properties": [{"key": k, "value": v} for k, v in p.items()]}
    entries = [
        entry("P1", entryAudit={"firstPublicDate": "2001-02-03"}, uniProtKBCrossReferences=[ref("GeneID", "7"), ref("GeneID", "8"), ref("Reactome", "R1", PathwayName="path"), ref("GO", "GO:1", GoTerm="P:grow", GoEvidenceType="IEA:x"), ref("GO", "GO:2", GoTerm="F:bind"), ref("GO", "3", GoTerm="P:live", GoEvidenceType="IDA:y")]),
        entry("P2", genes=[{"orfNames": [{"value": "orf"}]}], features=[{"type": "Chain", "featureId": "C1", "description": "one"}, {"type": "Chain", "featureId": "C2", "description": "two"}, {"type": "Helix", "featureId": "H"}]),
        entry("P3", genes=None, features=[{"type": "Chain", "featureId": "C3", "description": "only"}]),
    ]
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        json.dump({"results": entries}, f)
    e = proteome.read_entries(spark, str(tmp_path / "p.json.gz"))
    assert {(r.accession, r.date, r.symbol, r.gene, r.encoded) for r in proteome.proteins(e).collect()} == {("P1", "2001-02-03", "GP1", "7", True), ("P2", "1970-01-01", "orf", None, False), ("P3", "1970-01-01", None, None, False)}
    assert {(r.pathway, r.label, r.tier, r.role) for r in proteome.pathways(e).collect()} == {("REACT:R1", "path", 1, None), ("GO:1", "grow", 3, "IEA"), ("GO:3", "live", 2, "IDA")}
    assert {r.aspect: r.n for r in proteome.aspect_census(e).collect()} == {"P": 2, "F": 1}
    assert {(r.chain, r.single) for r in proteome.chains(e).collect()} == {("C1", False), ("C2", False), ("C3", True)}
    a, b = (spark.createDataFrame(x, "taxon int, acc string") for x in ([(1, "a"), (2, "b")], [(1, "x")]))
    assert sorted(r.acc for r in proteome.replaced_by(a, b).collect()) == ["b", "x"]
    lines = spark.createDataFrame([("9\t|\tHomo sapiens\t|\t\t|\tscientific name\t|",)], "value string")
    assert proteome.dump_rows(lines, ["id", "name", "unique", "kind"]).first() == ("9", "Homo sapiens", "", "scientific name")
    lists = spark.createDataFrame([("Secondary AC     Primary AC",), ("A0A001   P12345",), ("Q99999",), ("____",)], "value string")
    assert {tuple(r) for r in proteome.accession_list(lists).collect()} == {("A0A001", "P12345"), ("Q99999", None)}
    with pytest.raises(Exception, match="claimed twice"):
        proteome.exclusive_refs(spark.createDataFrame([("d", ["x"]), ("e", ["x"])], "disease string, xrefs array<string>")).collect()


def test_assembly_merges_layers_by_precedence(spark):
    n, e = "id string, class string, label string, line_no long", "subject string, predicate string, object string, source string, publications array<string>, line_no long"
    layers = {
        "gtop": (spark.createDataFrame([("a", "X", "late", 1), ("b", "Y", "b", 2)], n), spark.createDataFrame([("a", "P", "b", "s2", ["1", "2"], 1)], e)),
        "chembl": (spark.createDataFrame([("a", "X", None, 1), ("b", "X", None, 2)], n), spark.createDataFrame([("a", "P", "b", "s1", ["2"], 1), ("a", "P", "c", "s1", None, 2)], e)),
    }
    nodes, edges, fates = assemble.assemble(layers, properties=["label"])
    assert {(r.id, r["class"], r.label) for r in nodes.collect()} == {("a", "X", "late"), ("b", "X", None)}
    assert {(r.object, r.source, r.support_count, tuple(r.publications)) for r in edges.collect()} == {("b", "s1|s2", 2, ("1", "2")), ("c", "s1", 1, ())}
    assert {(r.layer, r.kind): (r.rows, r.new, r.merged, r.rejected) for r in fates.collect()} == {("chembl", "nodes"): (2, 2, 0, 0), ("gtop", "nodes"): (2, 0, 1, 1), ("chembl", "edges"): (2, 2, 0, 0), ("gtop", "edges"): (1, 0, 1, 0)}
    assert assemble.reconcile(fates, nodes, edges).count() == 0


def test_accounting_adds_up_where_layers_share_ids(spark, tmp_path):
    spark.createDataFrame([(0, 50, "t"), (100000, 50, "t")], "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")  # part 0 in the layer "extra" is 100000 too
    spark.createDataFrame([(1, 0, 50.0, "R")], "l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.layer, r.kind): (r.rows, r.new, r.merged, r.rejected) for r in QUERIES["assembly_accounting"](spark, str(tmp_path)).collect()}
    assert got == {("chembl", "nodes"): (2, 2, 0, 0), ("gtop", "nodes"): (1, 0, 1, 0), ("extra", "nodes"): (2, 1, 0, 1), ("chembl", "edges"): (1, 1, 0, 0), ("gtop", "edges"): (1, 0, 1, 0)}


def test_split_sink(spark, tmp_path):
    edges = spark.createDataFrame([("a", "P", "b", None, "s", 2000), ("a", "P", "c", None, "s", 2020), ("c", "L", "d", None, "s", 1999)], "subject string, predicate string, object string, qualifier string, source string, year int")
    nodes = spark.createDataFrame([(x, "X") for x in "abcd"], "id string, class string")
    labels = spark.createDataFrame([("train", "v", "a", "positive"), ("test", "v", "b", "negative")], "split string, virus string, id string, label string")
    release.write_split(temporal.training_edges(edges, 2010, ["L"]), nodes, labels, str(tmp_path / "split"), {"cutoff": 2010})
    back = spark.read.parquet(str(tmp_path / "split/nodes.parquet"))
    assert sorted(r.id for r in back.collect()) == ["a", "b"] and spark.read.parquet(str(tmp_path / "split/labels.parquet")).where("split = 'test'").count() == 1
    assert json.loads(spark.read.text(str(tmp_path / "split/derived_from")).first()[0]) == {"cutoff": 2010}


def test_refusals(spark):
    seen = spark.createDataFrame([("a", 1, 5, 9), ("b", 0, 4, 4)], "assay string, sign int, negative long, positive long")
    screens.refuse_polarity(seen.where("assay = 'a'"), spark.createDataFrame([("a", 1)], "assay string, declared int"), ["assay"])
    with pytest.raises(screens.PolarityError):
        screens.refuse_polarity(seen, spark.createDataFrame([("a", 1), ("b", -1)], "assay string, declared int"), ["assay"])
    with pytest.raises(ValueError):
        texts.top_concentration(["conc0"])
    df = spark.createDataFrame([(5.0, None), (None, None)], "`CONC0(M)` double, conc_uM double")
    with pytest.raises(Exception, match="implausible"):
        df.select(texts.top_concentration(["CONC0(M)", "conc_uM"])).collect()
    with pytest.raises(ValueError):
        screens.dose_series(df, F.lit(True), "maybe")
    with pytest.raises(ValueError):
        studies.degree_null(Graph(df, df, frozenset()), [], "X")
    assert 0.5 < studies.detectable_auc(400, 400, 1.96) < studies.detectable_auc(40, 40, 1.96) < 0.7


def test_population_sizes_count_the_pairs_without_making_them(spark):
    rng = random.Random(6)
    c = [(rng.choice("vw"), rng.randrange(40)) for _ in range(70)] + [(None, 3), ("v", None), ("u", 90)]
    f = [x for x in c if x[1] and x[1] % 3 == 0] + [("v", None), ("v", 77)]
    p = [(rng.randrange(80), rng.randrange(25)) for _ in range(160)] + [(None, 1), (3, None), (77, 99)]
    c, f, p = (spark.createDataFrame(x, y) for x, y in ((c, "virus string, id int"), (f, "virus string, id int"), (p, "id int, publication int")))
    pairs = studies.reference_population(c.distinct(), f.distinct(), p, ["virus"])
    sizes = studies.population_sizes(c, f, p, ["virus"])
    assert sorted(sizes.collect()) == sorted(pairs.groupBy("virus", "id").agg(F.count("*").alias("n")).collect()) and sizes.count() > 30
    key = lambda df: sorted(df.collect(), key=str)
    assert key(studies.emptied_candidates(c, sizes, ["virus"])) == key(studies.emptied_candidates(c, pairs, ["virus"]))


def test_genes_of_families_are_expanded_last(spark):
    rows = [(i, f"G{i % 7}") for i in range(60)] + [(3, "G3"), (70, None)]
    genes, families = [(f"G{i}", i % 3) for i in range(6)] + [("G5", 7), ("G6", None)], [(f, f"T{f}{i}") for f in range(3) for i in range(20 * f)] + [(1, "T10"), (1, None), (7, "T7")]
    df, g, f = (spark.createDataFrame(x, y) for x, y in ((rows, "row int, gene string"), (genes, "gene string, family int"), (families, "family int, protein string")))
    got = proteome.expand_genes(df, g, families=f.where("protein is not null"))
    want = proteome.expand_genes(df, g.join(f, "family").where("protein is not null").select("gene", "protein")).select("row", "gene", "protein")
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == ["row", "gene", "protein"]
    plan = QUERIES["gene_expansion"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_proteins" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]
    assert "supplier" in plan and plan.count("Exchange") >= 4 and plan.index("Generate explode(_proteins") < plan.index("SortMergeJoin")


def test_populations_of_a_large_table_make_no_pairs(spark, tmp_path):
    spark.range(60_000).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")  # 720 million pairs in one cell
    spark.range(60_000).selectExpr("id AS l_partkey", "id div 2 AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    began = time.monotonic()
    n = QUERIES["scorer_population"](spark, str(tmp_path)).groupBy("n").count().collect()
    assert dict((r.n, r["count"]) for r in n) == {12_000: 36_000, 11_999: 24_000}
    assert QUERIES["emptied_candidates"](spark, str(tmp_path)).collect() == [(1, 60_000, 0)]
    assert time.monotonic() - began < 60


def test_distances_equal_a_plain_search(spark):
    pairs = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(50, 51)]
    got = {r.id: r.distance for r in graph.distances(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string"), spark.createDataFrame([("0",)], "id string"), 4).collect()}
    want, front = {"0": 0}, {"0"}
    for h in range(1, 5):
        front = {str(y) for a, b in pairs for x, y in ((a, b), (b, a)) if str(x) in front} - set(want)
        want |= {x: h for x in front}
    assert got == want
