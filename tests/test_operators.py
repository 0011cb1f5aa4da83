"""Operators on small hand-made matrices."""

from itertools import combinations
from unittest.mock import MagicMock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.config import Settings
from cohortlens.operators import advanced, bootstrap, charts, communities, graph, mining, pairs, patterns, report, resistance, scores, strata, synth, validation
from cohortlens.sources.matrix import DRUG_CLASSES, FEATURES, BinaryMatrix, discover, feature_roles, from_wide, read_delimited, sniff_delimiter, to_wide


def matrix(spark, rows: dict[str, str], names: str, role: str = "gene") -> BinaryMatrix:
    ones = [(r, f) for r, has in rows.items() for f in has]
    f = spark.createDataFrame([(n, role, i, None) for i, n in enumerate(names)], FEATURES)
    return BinaryMatrix(spark.createDataFrame(ones, "row string, feature string"), spark.createDataFrame([(r,) for r in rows], "row string"), f)


@pytest.fixture(scope="module")
def toy(spark):
    return matrix(spark, {"1": "AB", "2": "AB", "3": "AB", "4": "C", "5": "C", "6": "", "7": "ABC"}, "ABCD")


def test_sources(spark, tmp_path):
    assert discover(["x.csv", "MIC.csv"]) == "MIC.csv" and discover(["b.csv", "a.csv", "t.txt"]) == "a.csv" and discover([]) is None
    assert sniff_delimiter("a;b;c,d") == ";" and sniff_delimiter("a") == ","
    (tmp_path / "m.csv").write_text("Strain_ID;Oxytetracycline;aph(3')-III;MLST\ns1;1;0;7\ns2;0;1;8\ns3;;1;8\n")
    df = read_delimited(spark, f"file://{tmp_path}/m.csv")
    m = from_wide(df)
    assert {(r.row, r.feature) for r in m.ones.collect()} == {("s1", "Oxytetracycline"), ("s2", "aph(3')-III"), ("s3", "aph(3')-III")}
    assert m.rows.count() == 3 and from_wide(df, null_is_one=True).ones.count() == 4
    assert {tuple(r) for r in to_wide(m, ["Oxytetracycline"]).collect()} == {("s1", 1), ("s2", 0), ("s3", 0)}
    assert [r[1] for r in feature_roles(["Strain_ID", "Tiamulin", "x", "serotype"])] == ["phenotype", "gene"]


def test_empty_matrix(spark):
    m = matrix(spark, {}, "AB")
    assert pairs.joint_counts(m).count() == 0 and pairs.cooccurrence(m).count() == 0 and graph.network_edges(m).count() == 0
    assert mining.patterns(m).count() == 0 and mining.frequent_itemsets(m).count() == 0
    assert pairs.prevalence(m).agg(F.sum("k")).first()[0] == 0


def test_class_resistance_wide(spark):
    df = spark.createDataFrame([("a", 1, 0, 1), ("b", 0, 1, 0), ("c", 0, None, 0)], "Strain_ID string, Oxytetracycline int, Doxycycline int, Penicillin int")
    rows = {r.row: (r.Tetracyclines, r.Penicillins, r.Macrolides) for r in resistance.class_resistance_wide(df, DRUG_CLASSES).collect()}
    assert rows == {"a": (1, 1, 0), "b": (1, 0, 0), "c": (0, 0, 0)}
    assert {(r.row, r.Tetracyclines) for r in resistance.class_resistance(from_wide(df)).collect()} == {("a", 1), ("b", 1), ("c", 0)}


def test_binarise_genes(spark):
    df = spark.createDataFrame([("a", "present", "1", 0.7), ("b", "", "0", 2.0), ("c", None, "2", 1.0)], "id string, g string, h string, x double")
    got = {r.id: (r.g, r.h, r.x) for r in resistance.binarise_genes(df, ["g", "h", "x"], "id").collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 2), "c": (0, 2, 1)}


def test_pair_tables(toy):
    t = {(r.item1, r.item2): (r.n00, r.n01, r.n10, r.n11) for r in pairs.contingency(toy, every=True).collect()}
    assert t[("A", "B")] == (3, 0, 0, 4) and t[("A", "C")] == (1, 2, 3, 1) and t[("C", "D")] == (4, 0, 3, 0)
    assert ("A", "D") not in {(r.item1, r.item2) for r in pairs.contingency(toy).collect()}
    x = {(r.item1, r.item2): r.n for r in pairs.cooccurrence_matrix(toy).collect()}
    assert x[("A", "A")] == 4 and x[("A", "B")] == x[("B", "A")] == 4 and ("A", "D") not in x
    p = {(r.item1, r.item2): r.phi for r in pairs.phi_matrix(toy).collect()}
    assert p[("A", "B")] == p[("B", "A")] == pytest.approx(1.0) and p[("A", "D")] == 0
    j = {(r.item1, r.item2): r.distance for r in pairs.jaccard_distances(toy).collect()}
    assert j[("A", "B")] == 0 and j[("A", "D")] == 1 and j[("A", "C")] == pytest.approx(1 - 1 / 6)


def test_adjustments(spark):
    p = [0.001, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.5]
    df = spark.createDataFrame([(f"i{k}", f"j{k}", x) for k, x in enumerate(p)], "item1 string, item2 string, p double")
    got = [r.adj_p for r in pairs.adjust(df).orderBy("p").collect()]
    assert got == pytest.approx([0.008, 0.04, 0.16 / 3, 0.06, 0.08, 0.8 / 6, 1.6 / 7, 0.5])
    tied = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.01), ("a", "d", 0.04)], "item1 string, item2 string, p double")
    assert {r.item2: r.adj_p for r in pairs.adjust(tied).collect()} == pytest.approx({"b": 0.015, "c": 0.015, "d": 0.04})
    with pytest.raises(ValueError):
        pairs.adjust(df, method="no such")


def test_patterns_and_rules(toy):
    got = {r.row: r.pattern for r in mining.patterns(toy, mining.NO_GENOTYPE).collect()}
    assert got["7"] == ["A", "B", "C"] and got["6"] == ["No_Genes"]
    sets = {tuple(r["items"]): r.n for r in mining.frequent_itemsets(toy, 0.1).collect()}
    assert sets == {("A",): 4, ("B",): 4, ("C",): 3, ("A", "B"): 4, ("A", "C"): 1, ("B", "C"): 1, ("A", "B", "C"): 1}
    rules = {(tuple(r.antecedents), tuple(r.consequents)): r for r in mining.association_rules(mining.frequent_itemsets(toy, 0.1), 0.0).collect()}
    assert len(rules) == 3 * 2 + 6
    r = rules[(("A",), ("B",))]
    assert (r.confidence, r.lift, r.conviction) == (1.0, pytest.approx(7 / 4), float("inf"))


def test_itemsets_of_any_length(spark):
    names = list("ABCDEFGHI")
    ones = spark.createDataFrame([(r, f) for r in ("1", "2", "3") for f in names if r < "3" or f < "C"], "row string, feature string")
    m = BinaryMatrix(ones, spark.createDataFrame([("1",), ("2",), ("3",)], "row string"), None)
    got = {tuple(r["items"]): r.n for r in mining.frequent_itemsets(m, 0.5).collect()}
    assert got == {c: 3 if set(c) <= {"A", "B"} else 2 for k in range(1, 10) for c in combinations(names, k)}
    assert max(len(r["items"]) for r in mining.frequent_itemsets(m, 0.5, longest=3).collect()) == 3


def test_replicates_in_one_pass(spark):
    m = matrix(spark, {str(i): ("AB" if i % 2 else "") + ("C" if i % 3 == 0 else "") + ("D" if i % 7 < 3 else "") + ("E" if i % 5 == 0 else "") for i in range(60)}, "ABCDE")
    w = bootstrap.row_weights(m.rows, 6, 42)
    want = {(r.ord, r.replicate): r.n for r in m.ones.join(m.features, "feature").join(w, "row").groupBy("ord", "replicate").agg(F.sum("weight").alias("n")).collect()}
    want |= {(bootstrap.ALL, r.replicate): r.n for r in w.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()}
    assert {(r.key, r.replicate): r.n for r in bootstrap.feature_sums(m, 6, 42).collect() if r.n} == want
    edges = lambda df: {(r.src, r.dst): (r.confidence, r.high_confidence) for r in df.collect()}
    got = edges(advanced.network_confidence(m, 6))
    assert ("A", "B") in got and got == edges(advanced.edge_confidence(m, advanced.network_by_replicate(), 6))


def test_registered_replicates(monkeypatch):
    from cohortlens.plans import catalogue

    seen = {}
    monkeypatch.setattr(catalogue, "star_matrix", lambda *_: MagicMock())
    monkeypatch.setattr(catalogue, "_read", lambda *_: MagicMock())
    monkeypatch.setattr(catalogue.F, "col", MagicMock())

    def note(name, *args):
        seen[name] = args[-1]
        raise InterruptedError

    for owner, name in ((bootstrap, "grouped_statistic"), (bootstrap, "joint_intervals"), (advanced, "rules_with_intervals"), (advanced, "network_confidence"), (advanced, "pattern_stability")):
        monkeypatch.setattr(owner, name, lambda *a, name=name: note(name, *a))
    for q in ("t11_grouped_bootstrap", "t12_joint_bootstrap", "x1_rules_with_intervals", "x2_edge_confidence", "x4_pattern_stability"):
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[q](None, "")
    assert seen == {"grouped_statistic": 1000, "joint_intervals": 1000, "rules_with_intervals": 500, "network_confidence": 500, "pattern_stability": 500}


def test_draws(spark):
    """Alike in numpy and Spark, and as even as they should be."""
    import numpy as np

    from cohortlens.functions import draws

    keys = [0, 1, 5, 2**31 - 1, 2**40 + 3, 2**62]
    df = spark.createDataFrame([(k, b) for k in keys for b in range(20)], "row long, replicate int")
    for r in df.withColumn("u", draws.unit(F.col("row"), F.col("replicate"), 42)).withColumn("m", draws.unit_md5_column(F.lit(42), F.col("row"), F.col("replicate"))).collect():
        assert r.u == draws.unit(np.array([r.row]), np.array([r.replicate]), 42)[0] and r.m == draws.unit_md5(42, r.row, r.replicate)
    u = draws.unit(np.arange(20_000)[:, None], np.arange(100)[None, :], 7)
    assert abs(u.mean() - 0.5) < 0.001 and abs(u.var() - 1 / 12) < 0.001 and abs(np.corrcoef(u.T) - np.eye(100)).max() < 0.04
    x = bootstrap.binomial_draws(1000, 300, np.array([draws.unit_md5(i) for i in range(20_000)]))
    assert abs(x.mean() - 300) < 0.5 and abs(x.std() - 210**0.5) < 0.3
    assert bootstrap.binomial_draws(7, 0, u[0]).max() == 0 and bootstrap.binomial_draws(7, 7, u[0]).min() == 7


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([("Gene_A", "Gene_B", 0.8), ("Gene_B", "Phenotype_X", 0.6)], "src string, dst string, phi double")


def test_centralities(path):
    assert {r.id: r.degree_centrality for r in graph.degree_centrality(path).collect()} == {"Gene_A": 0.5, "Gene_B": 1.0, "Phenotype_X": 0.5}
    sp = graph.shortest_paths(path)
    assert {(r.src, r.dst): r.distance for r in sp.collect()}[("Gene_A", "Phenotype_X")] == 2
    assert {r.id: r.betweenness for r in graph.betweenness(sp).collect()} == {"Gene_A": 0, "Gene_B": 1, "Phenotype_X": 0}
    e = {r.id: r.eigenvector for r in graph.eigenvector_centrality(path).collect()}
    assert e["Gene_B"] == pytest.approx(2**-0.5, abs=1e-6) and e["Gene_A"] == pytest.approx(0.5, abs=1e-6)


def test_louvain(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    got = {r.id: r.community for r in communities.louvain(spark.createDataFrame(e, "src string, dst string"), None).collect()}
    assert len(set(got.values())) == 2 and got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]


def test_row_risk(spark, path):
    m = matrix(spark, {"s1": ["Gene_A"], "s2": ["Gene_A", "Gene_B"], "s3": []}, ["Gene_A", "Gene_B", "Phenotype_X"])
    s = graph.degree_centrality(path).select("id", F.col("degree_centrality").alias("node_score"))
    got = {r.row: (r.risk, round(r.percentile_rank, 6), r.predicted) for r in graph.row_risk(m, s).collect()}
    assert got == {"s1": (0.5, 66.666667, False), "s2": (1.5, 100.0, True), "s3": (0.0, 33.333333, False)}
    ci = spark.createDataFrame([("Gene_A", 0.2, 0.2), ("Gene_B", 0.1, 0.4)], "feature string, lo double, hi double")
    w = {r.feature: r.weight for r in graph.ci_weights(ci).collect()}
    assert w["Gene_B"] == 1.0 and w["Gene_A"] == pytest.approx(0.31)


def test_scores(spark, path):
    sp = graph.shortest_paths(path)
    comm = spark.createDataFrame([("Gene_A", 1), ("Gene_B", 1), ("Phenotype_X", 2)], "id string, community int")
    tests = spark.createDataFrame([("Gene_B", "Gene_A", 0.9, 0.001)], "item1 string, item2 string, phi double, p double")
    want = spark.createDataFrame([("Gene_A", "Gene_B"), ("Gene_A", "Phenotype_X"), ("u", "v")], "gene1 string, gene2 string")
    got = {(r.gene1, r.gene2): r.cs for r in scores.coselection_scores(want, tests, sp, comm).collect()}
    assert got == pytest.approx({("Gene_A", "Gene_B"): 0.4 * 0.9 + 0.15 + 0.3, ("Gene_A", "Phenotype_X"): 0.1, ("u", "v"): 0.3})
    mods = scores.coselection_modules(tests, sp, comm)
    assert [(r.module_id, r.genes, r.n_genes) for r in mods.collect()] == [(1, ["Gene_A", "Gene_B"], 2)]
    t = scores.intervention_targets(path, sp, comm, tests, mods).collect()
    assert t[0].gene == "Gene_B" and t[0].priority == pytest.approx(0.3 * 0.9 + 0.2 + 0.2 + 0.2 + 0.1)
    assert [r.gene for r in scores.rank_by_potential(tests, sp, comm, 2).orderBy("rank").collect()] == ["Gene_B", "Gene_A"]


def test_bootstrap(toy):
    a = {r.feature: tuple(r)[1:] for r in bootstrap.bootstrap_ci(toy, 2000).collect()}
    b = {r.feature: tuple(r)[1:] for r in bootstrap.bootstrap_ci(toy, 2000).collect()}
    assert a == b and a["A"][0] == pytest.approx(400 / 7, abs=2) and a["D"] == (0, 0, 0)
    exact = {r.feature: (r.mean, r.lower, r.upper) for r in bootstrap.exact_intervals(pairs.prevalence(toy)).collect()}
    assert exact["A"] == pytest.approx((4 / 7, 1 / 7, 6 / 7)) and exact["D"] == (0, 0, 0)
    joint = {r.feature: r for r in bootstrap.joint_intervals(toy, 200).collect()}
    assert joint["A"].lower == joint["B"].lower and joint["A"].upper == joint["B"].upper  # equal columns stay equal
    with pytest.raises(ValueError):
        bootstrap.grouped_statistic(toy.ones, "mode")


def test_advanced(toy):
    assert [(r.feature1, r.feature2) for r in advanced.redundant_pairs(toy).collect()] == [("A", "B")]
    e = advanced.edge_confidence(toy, lambda rows: strata.cell_counts(rows, ["replicate"], "has", weight="n").where("item2 is not null and n >= 2").select("replicate", F.col("item1").alias("src"), F.col("item2").alias("dst")), 4)
    assert all(0 < r.confidence <= 1 for r in e.collect())
    common = lambda rows: rows.select("replicate", "n", F.explode("has").alias("feature")).groupBy("replicate", "feature").agg(F.sum("n").alias("n")).where("n >= 3")
    again = {r.feature: r.stability for r in advanced.pattern_recurrence(toy, common, 40).collect()}
    assert again["D"] == 0 and again == {r.feature: r.stability for r in advanced.pattern_stability(toy, replicates=40, found=lambda n, total: n >= 3).collect()}
    assert {r.feature: r.stability for r in advanced.pattern_stability(toy, replicates=10).collect()}["D"] == 0
    assert set(advanced.comprehensive(toy)) == {"association_rules", "redundancy"}


def test_validation(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 1.0), ("c", None, 0.0)], "id string, x int, y double")
    ok, said = validation.validate_input(df, "id")
    assert not ok and any("repeated" in s for s in said) and any("y has fractions" in s for s in said) and any(s.startswith("warning: x lacks") for s in said)
    assert validation.validate_input(df.limit(0), "id") == (False, ["error: no rows"])
    assert validation.validate_input(df, "nope")[0] is False
    assert validation.validate_output(3, 2) and not validation.validate_output(1, 2, 2)
    s = {r.column: r for r in validation.column_summary(df, ["x", "y"]).collect()}
    assert s["x"].is_binary and not s["y"].is_binary and s["x"].missing_share == pytest.approx(1 / 3)


def test_adversarial_columns(spark):
    m = from_wide(synth.adversarial(spark))
    names = {r.item1 for r in pairs.contingency(m).collect()} | {r.item2 for r in pairs.contingency(m).collect()}
    assert "All_Zeros" not in names and "All_Ones" not in names
    phi = {(r.item1, r.item2): r.phi for r in pairs.phi_matrix(m).collect()}
    assert phi[("Perfect_Pos_A", "Perfect_Pos_B")] == pytest.approx(1) and phi[("Perfect_Neg_A", "Perfect_Neg_B")] == pytest.approx(-1)


def test_synthetic(spark):
    m, truth = synth.synthetic_matrix(spark, 400)
    again, _ = synth.synthetic_matrix(spark, 400)
    assert m.ones.exceptAll(again.ones).count() == 0
    assert validation.validate_synthetic(m, truth["prevalences"], 400) == []
    assert len(truth["correlations"]) == 5


def test_pattern_store(spark):
    df = spark.createDataFrame([(f"p{i}", "2-way", 2, i / 10, 0.5, 1.0, "a%b,c" if i % 2 else "d") for i in range(6)], "pattern_id string, pattern_type string, pattern_length int, support double, confidence double, lift double, genes string")
    assert [r.pattern_id for r in patterns.query_patterns(df, 0.2, genes=["a%"]).collect()] == ["p5", "p3"]
    assert [r.pattern_id for r in patterns.query_patterns(df, page=2, page_size=2).collect()] == ["p3", "p2"]
    assert patterns.pattern_statistics(df).first()["total_patterns"] == 6


def test_settings():
    for bad in ({"confidence": 1}, {"alpha": 0}, {"n_iterations": 5}, {"fdr_method": "x"}, {"min_support": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_more_generators(spark, tmp_path):
    m, tied = synth.cooccurring_matrix(spark, 1000)
    assert {(r.item1, r.item2) for r in pairs.cooccurrence(m).collect()} >= set(tied)
    m, truth = synth.clustered_matrix(spark, 100)
    assert m.rows.count() == 100 and len(truth["rates"]) == 13
    synth.save_synthetic(m, truth, f"file://{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/s/merged").count() == 100


def test_charts(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(31)] + [(None, "a")], "x double, g string")
    h = {r.bin: r.n for r in charts.histogram(df, "x").collect()}
    assert sum(h.values()) == 31 and h[30] == 2 and set(h) == set(range(1, 31))
    assert charts.histogram(df.limit(0), "x").count() == 0
    assert {r.g: r.median for r in charts.spread_by_group(df, "x", "g").collect()} == {"a": 15.0, "b": 15.0}
    assert charts.extremes(df.na.drop(), "x", "g", 2).count() == 4


def test_reports(spark, toy, tmp_path):
    t = pd.DataFrame({"a": [1.23456, 2.0], "b": ["x<y", "z"]})
    assert "1.235" in report.table_html(t, "T") and "x&lt;y" in report.table_html(t, "T") and t.a[0] == 1.23456
    assert "No data available." in report.table_html(t.head(0), "T")
    assert len(report.write_triple(t, tmp_path / "r", "one", "said", {"ok": True})) == 3
    page = report.advanced_html({"redundancy": advanced.redundant_pairs(toy)}, f"{tmp_path}/a.html")
    assert "Redundancy" in open(page).read()
    assert report.shown(toy.ones, "unused")[0].shape[1] == 2
