"""Small fixtures for operators: traps of ties, parallel edges, cycles, undated edges, empty input and gates."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.functions import scalar, stats
from metaloom.operators import ask, assemble, evaluate, graph, rank, similarity, temporal, transforms, validate
from metaloom.plans import layers, metapath
from metaloom.queries import QUERIES
from metaloom.sources import release
from metaloom.sources.graph_view import Graph

EDGE = "subject string, predicate string, object string, qualifier string, source string, year int"


def make(spark, nodes, edges, symmetric=()):
    return Graph(spark.createDataFrame(nodes, "id string, class string"), spark.createDataFrame([(*e, *[None] * (6 - len(e))) for e in edges], EDGE), frozenset(symmetric))


def brute(nodes, edges, path, symmetric, degree, blocked=()):
    kind, out = dict(nodes), {}

    def go(at, seen, i, w):
        if i == len(path.hops):
            s, n = out.get((seen[0], at), (0.0, 0))
            out[seen[0], at] = (s + w, n + 1)
            return
        hop = path.hops[i]
        for s, p, o, *q in edges:
            if p != hop.predicate or (p in path.constraints and (not q or q[0] != path.constraints[p])):
                continue
            for a, b in ([(s, o), (o, s)] if p in symmetric else [(o, s)] if hop.reverse else [(s, o)]):
                if a == at and kind.get(b) == hop.target and b not in seen and not (i + 1 < len(path.hops) and b in blocked):
                    go(b, [*seen, b], i + 1, w * degree[b] ** -0.4)

    for i, c in nodes:
        if c == path.start:
            go(i, [i], 0, 1.0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_walks_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"{c}:{i}", c) for c, n in (("A", 5), ("B", 6), ("C", 3)) for i in range(n)]
    ids = [n for n, _ in nodes]
    edges = [(rng.choice(ids), rng.choice("PQS"), rng.choice(ids), rng.choice(["x", "y", None])) for _ in range(70)]
    edges += edges[:9]
    path = metapath.parse("m", rng.choice([["A", "P", "B", "S", "B", "<Q", "A"], ["A", "S", "A", "S", "A", "P", "C"], ["B", "<P", "A", "Q", "B", "P", "C"]]), rng.choice([{}, {"P": "x"}]))
    g, blocked = make(spark, nodes, edges, "S"), ids[::4]
    deg = {r.id: r.degree for r in graph.degree(g.edges).collect()}
    for block in ((), blocked):
        frame = spark.createDataFrame([(b,) for b in block], "id string") if block else None
        got = {(r.start, r.end): (r.score, r.paths) for r in metapath.walk(g, path, graph.degree(g.edges), blocked=frame).collect()}
        want = brute(nodes, edges, path, {"S"}, deg, block)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_metapath_problems():
    triples, sym = {("A", "P", "B"), ("B", "S", "B")}, frozenset("S")
    check = lambda p: metapath.problems(metapath.parse("m", p), triples, sym, {"P", "S"})
    assert check(["A", "P", "B", "S", "B"]) == []
    assert check(["A", "X", "B"]) and check(["B", "<S", "B"]) and check(["A", "<P", "B"])
    with pytest.raises(ValueError):
        metapath.parse("m", ["A", "P"])


def test_degrees_and_aliases(spark):
    g = make(spark, [("a", "A"), ("b", "A"), ("c", "A")], [("a", "P", "b"), ("a", "P", "b"), ("a", "H", "c")])
    assert {r.id: r.degree for r in graph.degree_without(g.edges, ["H"]).collect()} == {"a": 2, "b": 2}
    for bad in ([], ["none"]):
        with pytest.raises(ValueError):
            graph.degree_without(g.edges, bad)
    al = spark.createDataFrame([("a", "x", 1), ("a", "b", 2), ("b", "c", 1), ("d", "e", 1), ("e", "d", 1), ("f", "zz", 1)], "subject string, object string, ordinal int")
    ids = spark.createDataFrame([(x,) for x in "abcdf"], "id string")
    assert {r.id: r.resolved for r in graph.resolve_aliases(ids, al, g.nodes).collect()} == {"a": "c", "b": "c", "c": "c", "d": None, "f": None}


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", 1, False), ("g", 1, True), ("g", 1, False), ("h", 5, True)], "k string, score int, positive boolean")
    assert sorted((r.k, r.percentile) for r in rank.midrank_percentile(df, "score", ["k"]).collect()) == [("g", 0.5)] * 3 + [("h", 1.0)]
    h = {r.k: r for r in rank.hits_range(df, "score", "positive", ["k"], 2).collect()}
    assert (h["g"].hits_min, h["g"].hits_max, round(h["g"].hits_expected, 6), h["g"].tie_at_cut) == (0, 1, round(2 / 3, 6), 3)
    assert (h["h"].hits_min, h["h"].hits_max) == (1, 1)
    m = {r.k: (r.mrr_max, round(r.mrr_min, 6)) for r in rank.mrr_range(df, "score", "positive", ["k"]).collect()}
    assert m == {"g": (1.0, round(1 / 3, 6)), "h": (1.0, 1.0)}


def test_verdicts(spark):
    cases = [("=", 10_000.0, True), ("=", 10_001.0, False), (">", 10_000.0, False), (">", 9_999.0, None), ("<", 10_000.0, True), ("<", 10_001.0, None), (None, 5.0, True), ("=", None, None)]
    df = spark.createDataFrame([(i, r, v) for i, (r, v, _) in enumerate(cases)], "i int, rel string, nm double")
    got = {r.i: r.v for r in df.select("i", scalar.relation_verdict(F.col("nm"), F.col("rel")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for *_, v in cases]


def test_auc_imputes_and_bounds(spark):
    scores = spark.createDataFrame([("v", "a", 3.0), ("v", "b", 2.0), ("v", "x", 1.0)], "v string, c string, score double")
    labels = spark.createDataFrame([("v", "a", True), ("v", "n", True), ("v", "b", False), ("v", "m", False)], "v string, c string, label boolean")
    r = evaluate.auc(scores, labels, ["v"], "c").first()
    assert (r.n_pos, r.n_neg, r.pos_scored, r.neg_scored) == (2, 2, 1, 1)
    assert math.isclose(r.auc, (2 + 0 + 0.5) / 4) and math.isclose(r.ceiling, (2 + 0.5) / 4) and math.isclose(r.floor, (0.5 + 1 + 0.5) / 4) and math.isclose(r.skill, 1.0)


def test_statistics(spark):
    tables = [(a, b, c, d) for a, b, c, d in itertools.product(range(0, 7, 2), repeat=4)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.select("*", stats.fisher_upper(*map(F.col, "abcd")).alias("p")).collect():
        assert math.isclose(r.p, stats.fisher_p(r.a, r.b, r.c, r.d), abs_tol=1e-9)
    ps = [0.1, 0.5, 0.9, 0.3]
    want = sum(math.prod(p if x else 1 - p for p, x in zip(ps, xs)) for xs in itertools.product([0, 1], repeat=4) if sum(xs) >= 2)
    assert math.isclose(spark.range(1).select(stats.poisson_binomial_tail(F.array(*map(F.lit, ps)), F.lit(2)).alias("t")).first().t, want)
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 1]))).astype(float)
    w, full = stats.ridge_logistic(x, y)
    _, reduced = stats.ridge_logistic(x[:, :1], y)
    assert w[1] > 1 and stats.likelihood_ratio(full, reduced)[1] < 1e-6
    assert 0.5 < stats.detectable_auc(30, 300) < stats.detectable_auc(5, 300) < 1
    assert stats.smallest_arm(0.9, 0.1) < stats.smallest_arm(0.7, 0.2) and stats.resolvable_steps(0.05, 99) == 5


def test_first_of_nodes_that_share_a_line(spark, tmp_path):
    n = [("x", "B", 0, 1, "q", None), ("x", "A", 0, 1, "s", "u"), ("x", "A", 0, 1, "r", "t")]
    for rows in (n, n[::-1]):
        got = assemble.merge_nodes(spark.createDataFrame(rows, "id string, class string, layer_rank int, line_no int, u string, v string").coalesce(1), ["u", "v"])
        assert [tuple(r) for r in got.collect()] == [("x", "A", "r", "t", 2)]
    for flags in ("RNA", "ANR", "NRA"):  # the same line number thrice: the row that the table has first
        items = spark.createDataFrame([(1, 5, 2, f, "O", 0.05, 0.01) for f in flags], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double")
        items.coalesce(1).write.parquet(f"{tmp_path}/{flags}/lineitem.parquet")
        assert QUERIES["node_merge_conflicts"](spark, f"{tmp_path}/{flags}").select("id", "flag", "conflicts").collect() == [(5, flags[0], 1)]


def test_nodes_that_share_a_line_in_different_files(spark, tmp_path):
    rows = [(1, 5, 2, "R", "O", 0.05, 0.01), (1, 5, 2, "N", "F", 0.05, 0.01), (1, 6, 2, "A", "O", 0.05, 0.07), (1, 6, 2, "R", "F", 0.05, 0.01)]  # part 5: other flags on one line, part 6: other classes
    for name, first, want in (("up", 0, {(5, "A", "R", "O", 2), (6, "B", "A", "O", 0)}), ("down", 1, {(5, "A", "N", "F", 2), (6, "A", "R", "F", 0)})):
        (tmp_path / name / "lineitem.parquet").mkdir(parents=True)
        for i in range(2):  # two files, read in the order of their names
            items = spark.createDataFrame(rows[(first + i) % 2 :: 2], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double")
            items.toPandas().to_parquet(f"{tmp_path}/{name}/lineitem.parquet/part-{i}.parquet", index=False)
        got = QUERIES["node_merge_conflicts"](spark, f"{tmp_path}/{name}").select("id", "class", "flag", "status", "conflicts").collect()
        assert {tuple(r) for r in got} == want


def test_merges(spark):
    w = spark.createDataFrame(
        [("s", "o", 1, 1, "b|a", None, "1970-01-01", "unknown"), ("s", "o", 0, 9, "c", 2.0, "2020-05-01", "inhibitor"), ("s", "o", 0, 2, "a", 3.0, "2020", "agonist"), ("t", "o", 0, 1, None, None, "1970-01-01", None)],
        "subject string, object string, layer_rank int, line_no int, source string, ic50 double, first_asserted_date string, direction string",
    )
    m = {r.subject: r for r in assemble.merge_edges(w, ["subject", "object"], precedence=["ic50"], ladders=assemble.LADDERS, derived_absence={"none": ["ic50"]}).collect()}
    assert (m["s"].support_count, m["s"].source, m["s"].first_asserted_date, m["s"].direction, m["s"].ic50, m["s"].none) == (3, "a|b|c", "2020", "contested", 3.0, False)
    assert (m["t"].source, m["t"].first_asserted_date, m["t"].direction, m["t"].none) == ("", "1970-01-01", None, True)
    n = spark.createDataFrame([("x", "A", 0, 1, None, "p"), ("x", "A", 1, 1, "q", "r"), ("x", "B", 2, 1, "z", "z")], "id string, class string, layer_rank int, line_no int, u string, v string")
    assert [tuple(r) for r in assemble.merge_nodes(n, ["u", "v"]).collect()] == [("x", "A", "q", "p", 1)]
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert {r.x: r.change for r in assemble.multiset_diff(a, a.where("x = 2").union(a)).collect()} == {2: 1}
    assert assemble.content_hash(a).first() == assemble.content_hash(a.orderBy(F.desc("x"))).first()
    ids = w.limit(1).select(assemble.fact_id(F.lit("a"), F.lit(None)).alias("a"), assemble.blake_fact_id(F.lit("a"), F.lit(None)).alias("b")).first()
    assert all(len(x) == 17 and x[0] == "E" for x in ids)


def test_temporal(spark):
    g = make(spark, [], [("a", "P", "b", None, "x", 2001), ("a", "Q", "b", None, "calc", None), ("a", "Q", "z", None, "calc", None), ("a", "H", "b", None, "x", 1999)])
    dated = temporal.date_computed(g.edges, ["calc"])
    assert {(r.object, r.year) for r in dated.where("source = 'calc'").collect()} == {("b", 1999), ("z", None)}
    count = lambda policy: temporal.training_edges(dated, 2000, ["H"], policy, ["calc"]).count()
    assert [count(p) for p in ("include", "exclude", "computed_only")] == [2, 1, 2]
    with pytest.raises(ValueError):
        count("maybe")
    rows = spark.createDataFrame([("v", "a", True, 1990), ("v", "a", True, 2010), ("v", "b", True, 1990), ("v", "b", False, 1990), ("v", "c", False, 2010)], "virus string, compound string, verdict boolean, year int")
    assert {tuple(r) for r in temporal.split_labels(rows, 2000).collect()} == {("train", "v", "a", True), ("test", "v", "c", False)}


def test_set_join_loses_nothing(spark):
    rng = random.Random(2)
    sets = [(i, [f"e{rng.randrange(25)}" for _ in range(rng.randint(0, 14))]) for i in range(120)]
    for t in (0.3, 0.6, 1.0):
        want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= t - 1e-12}
        got = {(r.a, r.b): r.similarity for r in similarity.set_join(spark.createDataFrame(sets, "id int, elements array<string>"), t).collect()}
        assert got == pytest.approx(want)


def test_set_join_over_few_elements_counts_bit_vectors(spark, monkeypatch):
    rng = random.Random(9)
    sets = [(f"é{i}", sorted(rng.sample(range(60), rng.randint(8, 30))) + [None] * (i % 2)) for i in range(90)] + [("none", []), ("null", None), (None, [1, 2])]
    df = spark.createDataFrame(sets, "id string, elements array<int>")
    own = {i: set(x) - {None} for i, x in sets if i and x}
    want = {(i, j): len(own[i] & own[j]) / len(own[i] | own[j]) for i, j in itertools.combinations(sorted(own), 2) if len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.33}
    for rows in (similarity.BLOCK_ROWS, 13):
        monkeypatch.setattr(similarity, "BLOCK_ROWS", rows)
        got = similarity.set_join(df, 0.33)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()  # no candidate rows by element
        assert {(r.a, r.b): r.similarity for r in got.collect()} == want and got.count() == len(want) > 100
    monkeypatch.setattr(similarity, "BITS", 59)
    got = similarity.set_join(df, 0.33)
    assert "FlatMapCoGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want


def test_fold_pairs_are_made_once_and_never_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), rng.choice(["none", "unknown", "serine", "zinc"]), [rng.choice(["f", "g", "h", None]) for _ in range(rng.randrange(4))]) for i in range(60)]
    rows += [rows[3], (rows[5][0], *rows[5][1:3], ["h", "k"]), (60, "x", "none", None), (61, "x", "none", ["k"])]
    own = {}
    for i, role, kind, folds in rows:
        own.setdefault((i, role, kind), set()).update(x for x in folds or [] if x)
    want = {(a[0], b[0], "|".join(sorted(own[a] & own[b]))) for a, b in itertools.permutations(own, 2) if a[0] < b[0] and own[a] & own[b]}
    for size in (transforms.FOLD_ROWS, 7):
        monkeypatch.setattr(transforms, "FOLD_ROWS", size)
        got = transforms.fold_pairs(spark.createDataFrame(rows, "id int, role string, catalytic_type string, folds array<string>"))
        assert sorted((r.a, r.b, r.shared) for r in got.collect()) == sorted(want)
        above = got._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
        assert "Exchange" not in above and "Aggregate" not in above


def test_validation(spark):
    g = make(spark, [("A:1", "A"), ("A:1", "A"), ("bad", "A"), ("X:1", "A"), ("B:1", "Z")], [("A:1", "P", "A:1", "q", "s"), ("A:1", "U", "A:1", "q", "s"), ("A:1", "P", "none", "q", "s"), ("A:1", "S", "A:1", None, None), ("A:1", "P", "B:1", "q", "s")])
    v = validate.validate_nodes(g.nodes, [validate.NodeClass("A", ("A",))])
    want = {"DUPLICATE_NODE": 2, "CURIE": 1, "PREFIX": 1, "UNKNOWN_NODE_CLASS": 1}
    assert validate.unexpected(v, want).collect() == []
    e = validate.validate_edges(g.edges, g.nodes, [validate.EdgeClass("A", "P", "A"), validate.EdgeClass("A", "S", "A", symmetric=True)])
    assert {r.code: r.n for r in validate.report(e).collect()} == {"UNKNOWN_PREDICATE": 1, "DANGLING": 1, "SYMMETRIC_SELF_LOOP": 1, "MISSING_PROVENANCE": 1, "UNDECLARED_TRIPLE": 1}


def test_transforms(spark):
    act = spark.createDataFrame([("c", "d", "v", 10.0, "vero"), ("c", "d", "v", 40.0, "huh7"), ("c", "d", "v", 20.0, "vero")], "compound string, document string, virus string, nm double, cell string")
    tox = spark.createDataFrame([("c", "d", 500.0, "huh7", False), ("c", "d", 900.0, "vero", True)], "compound string, document string, nm double, cell string, exact boolean")
    p = transforms.selectivity_pairs(act, tox)
    assert tuple(p.select("cc50", "ec50", "exact", "si").first()) == (900.0, 20.0, True, 45.0)
    assert tuple(transforms.selectivity_summary(p).first()) == ("c", "v", 45.0, 45.0, 1)
    s = spark.createDataFrame([(4.0, None, 1, None, False, 50.0), (1.1, 80.0, 1, 3.0, False, 50.0), (1.1, 80.0, -1, 3.0, False, 50.0), (1.1, 80.0, 1, 30.0, False, 50.0), (1.1, 80.0, 1, 3.0, True, 50.0)], "k double, e double, p int, a double, c boolean, t double")
    got = s.select(transforms.screen_verdict(*map(F.col, "kepact")).alias("v")).select("v.*").collect()
    assert [r.reason for r in got] == ["no_response", "active", "weak", "below_threshold", "cytotoxic"]
    chains = spark.createDataFrame([("a", "protease", "serine", ["f"]), ("b", "protease", "serine", ["f", "g"]), ("c", "protease", "none", ["g"]), ("d", "polymerase", "none", ["g"]), ("e", "protease", "unknown", ["f"])], "id string, role string, catalytic_type string, folds array<string>")
    assert {(r.a, r.b): r.mode for r in transforms.fold_pairs(chains).collect()} == {("a", "b"): "catalytic", ("a", "e"): "unknown_chemistry", ("b", "e"): "unknown_chemistry", ("b", "c"): "one_sided", ("b", "d"): "role_differs", ("c", "d"): "role_differs"}
    ind = spark.createDataFrame([("c", "d", 2, "N2"), ("c", "d", 4, None), ("c", "e", 2, None), ("c", "f", 1, "N1")], "compound string, disease string, phase int, registry_id string")
    assert {(r.disease, r.predicate, r.reference) for r in transforms.collapse_indications(ind).collect()} == {("d", "TREATS", "N2"), ("f", "IN_TRIAL_FOR", "N1")}
    acc = spark.createDataFrame([(x,) for x in ("P12345", "P00001", "Q00001", "P99999", "zz")], "accession string")
    sec = spark.createDataFrame([("P00001", "P12345"), ("Q00001", "P12345"), ("Q00001", "P23456")], "accession string, primary string")
    out = transforms.recover_accessions(acc, acc.where("accession = 'P12345'"), sec, acc.where("accession = 'P99999'"))
    assert {r.accession: r.status for r in out.collect()} == {"P12345": "primary", "P00001": "secondary", "Q00001": "demerged", "P99999": "deleted", "zz": "malformed"}


def test_sources(spark, tmp_path):
    assert release.resolve_header(["Sample-ID", "AC 50"], {"sample": ["sample_id"], "ac50": ["ac50"]}, ["sample"]) == {"sample": "Sample-ID", "ac50": "AC 50"}
    with pytest.raises(release.ColumnError):
        release.resolve_header(["x"], {"sample": ["sample_id"]}, ["sample"])
    line = "\t".join(["uniprotkb:P12345", "uniprotkb:Q1-PRO_000012", "-", "-", "-", "-", 'psi-mi:"MI:1"(two hybrid)', "Doe (2011)", "pubmed:77", "taxid:9606(human)", "taxid:11053(x)", "psi(direct)", "psi(intact)", "-", "score:0.5"])
    r = release.mitab(spark.createDataFrame([(line,), ("#c",), ("a\tb",)], "value string")).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].method, r[0].publication, r[0].taxon_b, r[0].score) == ("P12345", "Q1-PRO_000012", "two hybrid", "77", 11053, 0.5)
    df = spark.createDataFrame([(2, '{"a": 1}'), (1, None)], "id int, q string")
    df.write.parquet(str(tmp_path / "n.parquet"))
    assert sorted((r.id, r.q and r.q.a) for r in release.read_rows(spark, str(tmp_path / "n"), "id int, q string", {"q": "a int"}).collect()) == [(1, None), (2, 1)]
    assert release.read_rows(spark, str(tmp_path / "none"), "id int").count() == 0
    release.export_canonical(df, ["id"], str(tmp_path / "out"))
    release.export_canonical(df.orderBy(F.desc("id")).repartition(3), ["id"], str(tmp_path / "out2"))
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert text("out") == text("out2") and text("out").splitlines()[0] == '{"id":1}'
    (tmp_path / "t.tsv").write_text("# v1\nGene ID\tScore\nx\t1\n")
    assert release.banner(spark, str(tmp_path / "t.tsv"), r"# (v\d+)") == "v1"
    got = release.read_delimited(spark, str(tmp_path / "t.tsv"), {"gene": ["gene_id"], "score": ["score"]}, ["gene"])
    assert [tuple(r) for r in got.collect()] == [("x", "1")]


def test_plans():
    ls = [layers.Layer("a", ("in",), (), ("P",)), layers.Layer("b", (), ("a",), ("Q",)), layers.Layer("c", ("gone",), (), ("R",)), layers.Layer("d", (), ("c",))]
    steps = layers.plan(ls, {"in": "1"}, {})
    assert [(s["layer"], s["state"]) for s in steps] == [("a", "build"), ("b", "build"), ("c", "blocked"), ("d", "blocked")] or {s["layer"]: s["state"] for s in steps} == {"a": "build", "b": "build", "c": "blocked", "d": "blocked"}
    first = layers.stamp(ls[0], {"in": "1"}, {})
    done = {"a": first, "b": layers.stamp(ls[1], {}, {"a": first})}
    assert {s["layer"]: s["state"] for s in layers.plan(ls[:2], {"in": "1"}, done)} == {"a": "ok", "b": "ok"}
    assert {s["layer"]: s["reason"] for s in layers.plan(ls[:2], {"in": "2"}, done)} == {"a": "stale", "b": "stale"}
    assert layers.channel_availability(ls, steps, {"m": ["P"], "n": ["P", "R"], "o": ["T"]}) == {"m": [], "n": ["c"], "o": ["no layer makes T"]}
    with pytest.raises(ValueError):
        layers.order([layers.Layer("a", (), ("b",)), layers.Layer("b", (), ("a",))])
    assert layers.calibrate(0.6, 0.55, 12)["weight"] == pytest.approx(0.1) and layers.calibrate(0.6, 0.45, 12)["weight"] == 0


def test_ask(spark):
    names = spark.createDataFrame([("1", "Aspirin"), ("2", "Aspirin plus"), ("3", "Other")], "id string, name string")
    assert [r.id for r in ask.resolve(names, "aspirin").collect()] == ["1"]
    assert [r.id for r in ask.resolve(names, "spirin").collect()] == ["1", "2"]
    assert ask.classify_question("Why does it work?") == "explain" and ask.classify_question("Design a novel drug") == "prospecting"
    assert not ask.guard("prospecting", {"direct": 3}).allowed and not ask.guard("explain", {"direct": 0}).allowed
    assert ask.guard("explain", {"direct": 1}, {"thin": lambda r: r["direct"] < 2}).caveats == ("thin",)
    assert ask.follow_up("the second one", ["a", "b"]) == "b" and ask.follow_up("why is it so", ["a"]) == "a"
    facts = ["A inhibits B at 25 nM [E1f]."]
    assert ask.verify("A inhibits B at 25 nM [E1f].", facts, ["E1f"]) == []
    assert ask.verify("A inhibits B at 30 nM [E2].", facts, ["E1f"]) == ["unknown id E2", "stray number 30"]
    calls = []
    model = lambda prompt: calls.append(prompt) or ("A inhibits B [E1f]." if len(calls) == 1 else "A inhibits B [E1f]. Thin evidence.")
    assert ask.answer("q", facts, ["E1f"], ["thin evidence"], model).ok and len(calls) == 2
    assert ask.answer("q", facts, ["E1f"], []).verbalised == facts


def test_streaming(spark, tmp_path):
    from metaloom.streaming import events

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read_stream(spark, str(tmp_path / "in"), files=1), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.window_start, r.event_type, r.n) for r in spark.table("w").collect()} == {(r.window_start, r.event_type, r.n) for r in events.windowed(src).collect()}
    assert sum(r.n for r in events.sessions(src).collect()) == src.count()
    count = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n"))
    add = events.merge_into(str(tmp_path / "facts"), ["user_id"], count)
    for _ in range(2):
        add(src.limit(50), 0)
    add(src.limit(10), 1)
    assert spark.read.parquet(str(tmp_path / "facts-facts")).agg(F.sum("n")).first()[0] == 60
