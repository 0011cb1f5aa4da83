"""Workbooks, charts, report sections, pattern stores."""

import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import advanced, figures, patterns, report, scores, synth, workbook
from cohortlens.sources.matrix import FEATURES, BinaryMatrix

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_sheet(path, number):
    """Rows of a sheet as lists of (text or number, style)."""
    with zipfile.ZipFile(path) as z:
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{number}.xml"))
    return [[("".join(c.itertext()), int(c.get("s"))) for c in r.findall("m:c", NS)] for r in root.iter(f"{{{NS['m']}}}row")]


def test_workbook(tmp_path):
    t = pd.DataFrame({"gene": ["tet(O)", "<a&b>"], "phi": [0.123456, float("nan")], "n": [3, 4], "both": [["x", "y"], []], "ok": [True, False]})
    path = workbook.report_workbook(tmp_path / "r.xlsx", [("pairs: a/b", "Pairs that matter", t), ("pairs: a/b", "", t), ("none", "Nothing", t.head(0))], {"Seed": 42}, ["How it was done."], [("net.svg", "A network")])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{NS['m']}}}sheet")]
        for n in z.namelist():
            ET.fromstring(z.read(n))
    assert names == ["Metadata", "Methodology", "pairs_ a_b", "pairs_ a_b_2", "none", "Chart_Index"]
    assert [r[0][0] for r in read_sheet(path, 1)] == ["Item", "Seed", "Tables", "Charts"] and read_sheet(path, 2)[1][0][0] == "How it was done."
    rows = read_sheet(path, 3)
    assert rows[0][0] == ("Pairs that matter", workbook._NOTE) and [c[0] for c in rows[1]] == ["gene", "phi", "n", "both", "ok"]
    assert rows[2] == [("tet(O)", 0), ("0.1235", workbook._NUMBER), ("3", 0), ("x, y", 0), ("1", 0)] and rows[3][0][0] == "<a&b>" and len(rows[3]) == 4
    assert read_sheet(path, 5)[2][0][0] == "no rows" and read_sheet(path, 6)[1][1][0] == "net.svg"
    assert [workbook.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert len(workbook.sheet_names(["x" * 40, "x" * 40])[1]) == 31


def test_charts(tmp_path):
    place = figures.spring_layout([("a", "b"), ("b", "c"), ("d", "d")])
    assert set(place) == set("abcd") and place == figures.spring_layout([("b", "c"), ("a", "b"), ("d", "d")]) and max(abs(x) for p in place.values() for x in p) == pytest.approx(1)
    edges = pd.DataFrame({"src": ["a", "b"], "dst": ["b", "<c>"], "phi": [0.5, -0.2]})
    for svg in (figures.network_svg(edges, {"a": "gene"}, "N"), figures.bars_svg(["x", "y"], [1.0, 0.0], "B", [0.5, 0.0], [1.5, 0.1]), figures.histogram_svg(pd.DataFrame({"lo": [0.0], "hi": [1.0], "n": [3]}), "H"), figures.bars_svg([], [], "none")):
        ET.fromstring(svg)
    assert figures.save({"n": (figures.network_svg(edges, {}, "N"), "what")}, tmp_path) == [("n.svg", "what")] and (tmp_path / "n.svg").exists()


def test_sections_in_order(tmp_path):
    t = pd.DataFrame({"a": [1.23456]})
    names = ["targets", "gene_rules", "overview", "class_ci_all", "network", "extra"]
    text = open(report.write_html([(n, f"note of {n}", t) for n in names], tmp_path, "T", {"network": ("<svg></svg>", "edges")})).read()
    at = [text.index(x) for x in ("Overview", "1) Resistance to classes", "11) Rules among genes", "12) Network", "<svg>", "12b) Edges", "15) Co-selection", "note of extra", "Methods")]
    assert at == sorted(at) and "1.235" in text and "2) Resistance" not in text


def test_associations_of_any_shape(spark):
    rows = [("a", "b", 0.5, 0.01)]
    for names, want in (("Feature1 string, Feature2 string, Phi double, p_value double", ("a", "b", 0.5, 0.01)), ("Gene string, other string, phi double, p double", ("a", "a", 0.5, 0.01)),
                        ("item1 string, item2 string, phi double, p double", ("a", "b", 0.5, 0.01)), ("who string, whom string, x double, y double", ("a", "a", 0.0, 1.0))):
        assert tuple(scores.named_associations(spark.createDataFrame(rows, names)).first()) == want


def test_pattern_store(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i % 3}", i / 10, i % 2 == 0) for i in range(10)], "id int, genes string, support double, flag boolean")
    assert patterns.numeric_columns(df) == ["id", "support", "flag"]
    assert [r.id for r in patterns.query_table(df, ["id"], "support > 0.3", "support desc", 2).collect()] == [9, 8]
    for form in ("csv", "parquet"):
        assert patterns.export_filtered(df, f"{tmp_path}/{form}", "flag", form) == 5
    with pytest.raises(ValueError):
        patterns.export_filtered(df, f"{tmp_path}/x", form="xml")
    cells = spark.createDataFrame([(i, j, float(i * j)) for i in range(5) for j in range(5)], "i int, j int, v double")
    t = {(r.tile_row, r.tile_col): r for r in patterns.tiles(cells, "i", "j", "v", 3).collect()}
    assert (t[0, 0].n, t[0, 0].largest, t[1, 1].n, t[1, 1].least) == (9, 4.0, 4, 9.0)


def test_generators_and_hook(spark):
    clean = synth.clean_set(spark, 300, 4)
    noisy = synth.noisy_set(clean)
    assert noisy.columns == clean.columns and clean.where("Perfect_Corr_A <> Perfect_Corr_B").count() == 0
    both = clean.alias("c").join(noisy.alias("n"), "Strain_ID")
    flipped = both.agg(*[F.avg((F.col(f"c.{c}") != F.col(f"n.{c}")).cast("int")).alias(c) for c in clean.columns[1:]]).first()
    assert all(0.04 < x < 0.17 for x in flipped)
    tree = synth.random_tree(["a", "b", "c", "d"])
    assert tree == synth.random_tree(["a", "b", "c", "d"]) and tree.count("(") == tree.count(")") == 3 and tree.endswith(";") and synth.random_tree(["x"]).startswith("x:") and synth.random_tree([]) == ";"
    m = BinaryMatrix(spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B")], "row string, feature string"), spark.createDataFrame([("1",), ("2",), ("3",)], "row string"),
                     spark.createDataFrame([("A", "gene", 0, None), ("B", "gene", 1, None)], FEATURES))
    assert {r.feature: r.stability for r in advanced.pattern_stability(m, replicates=20, found=lambda n, total: n >= 0).collect()}["A"] > 60


def test_pages_and_environment(spark, tmp_path):
    from cohortlens.config import prepare_environment
    from cohortlens.sources.matrix import try_read_delimited

    assert prepare_environment(str(tmp_path), str(tmp_path / "a/b"))[1] == str(tmp_path / "a/b") and (tmp_path / "a/b").is_dir()
    assert prepare_environment("s3://x/y", str(tmp_path / "o"))[0] == "s3://x/y"
    path = report.save_page(report.light_html({"isolates": 3, "<x>": "&"}, "T"), tmp_path / "a/b", now=17.9)
    assert path.endswith("analysis_17.html") and "&lt;x&gt;" in open(path).read()
    report.write_csv([("targets", "", pd.DataFrame({"a": [1]}))], tmp_path / "a/b")
    found = report.collect_results(tmp_path / "a/b")
    assert found["html"] == [path] and found["csv"][0].endswith("intervention_targets_top20.csv") and found["xlsx"] == []
    assert try_read_delimited(spark, f"file://{tmp_path}/none.csv") is None


def test_saved_generator(spark, tmp_path):
    m, truth = synth.synthetic_matrix(spark, 20, 4, 3)
    synth.save_synthetic(m, truth, f"file://{tmp_path}/s")
    cols = {p: len(spark.read.option("header", True).csv(f"file://{tmp_path}/s/{p}").columns) - 1 for p in ("phenotypes", "genes", "virulence", "merged")}
    assert cols == {"phenotypes": 13, "genes": 4, "virulence": 3, "merged": 20}
    assert "20 isolates" in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/s/README.md").collect()) and spark.read.text(f"file://{tmp_path}/s/truth").count() == 1
