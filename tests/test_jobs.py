"""The jobs: against plain Python, over growing input, on odd tables, by their command lines."""

import json
import math
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import strata
from cohortlens.sources.markers import holding, mentioned
from jobs import association_atlas, registered, surveillance

ROOT = Path(__file__).resolve().parents[1]
PANEL = {"mark_a": "alpha", "mark_b": "(?i)beta", "mark_c": "[0-9]{3}"}
ATLAS = {"id": "doc_id", "text": "text", "stratum": "lang", "phenotypes": {"toxic": "toxic = 1", "poor": "quality = 0"}, "panel": PANEL, "least_rows": 1, "alpha": 0.05, "method": "fdr_bh"}
WATCH = {"source": "source", "source_type": "string", "text": "text", "multiple_from": 2, "confidence": 0.95, "method": "fdr_bh", "files_per_batch": 2, "panel": PANEL}
DOCS = "doc_id long, text string, lang string, source string"


def reports(n=240):
    words = ["alpha", "Beta", "beta 123", "", "x", "4567 alpha", None, "gamma\nBETA alpha"]
    langs, sources = ["en", "fr", None, "01"], ["s1", "s2", None]
    return [(i, words[i * i % 8 if i % 3 else i % 8], langs[i % 4], sources[i % 7 % 3]) for i in range(n)]


def found(text):
    return {k for k, p in PANEL.items() if text is not None and re.search(p, text)}


def assessed(n=240):
    return [(i, int(i % 5 > 1) if i % 11 else None, int(i % 8 in (1, 2, 5))) for i in range(n) if i % 13 != 4]


def test_panel(spark):
    rows = spark.createDataFrame(reports(), DOCS).select("text", mentioned(PANEL, F.col("text")).alias("m"), mentioned({}, F.col("text")).alias("e"), holding({}).alias("h"))
    assert all(set(r.m) == found(r.text) and r.e == [] and r.h == [] for r in rows.collect())


@pytest.mark.parametrize("cross", [False, True])
def test_counts_by_brute_force_and_their_sums(spark, cross):
    rows = [("a", ["x", "y", "x"], ["p"]), ("a", ["y"], []), (None, ["z", "x"], ["q", "p"]), (None, [], ["p"]), ("b", [], [])]
    df = spark.createDataFrame(rows, "lab string, l array<string>, r array<string>")
    want = Counter()
    for lab, l, r in rows:
        want[lab, None, None] += 1
        for x in {*l, *(r if cross else [])}:
            want[lab, x, None] += 1
        for x, y in ([(x, y) for x in {*l} for y in r] if cross else combinations(sorted({*l}), 2)):
            want[lab, x, y] += 1
    right = "r" if cross else None
    count = lambda d: {tuple(x[:3]): x[3] for x in d.collect()}
    assert count(strata.cell_counts(df, ["lab"], "l", right)) == want
    halves = [strata.cell_counts(df.where(c), ["lab"], "l", right) for c in ("lab = 'a'", "lab is null or lab = 'b'")]
    assert count(strata.merged(halves[0].union(halves[1]).union(halves[0]).union(halves[1]), ["lab"])) == {k: 2 * v for k, v in want.items()}


def test_atlas_by_brute_force(spark, tmp_path):
    docs, labels, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    spark.createDataFrame(reports(), DOCS).write.parquet(docs)
    spark.createDataFrame(assessed(), "doc_id long, quality int, toxic int").write.parquet(labels)
    first = association_atlas.run(spark, docs, labels, out, ATLAS)
    got = {(r.lang, r.phenotype, r.marker): (r.n00, r.n01, r.n10, r.n11) for r in first.collect()}
    label = {i: {k for k, yes in (("toxic", t == 1), ("poor", q == 0)) if yes} for i, q, t in assessed()}
    want = {}
    for lang in {r[2] for r in reports()}:
        rows = [(label[i], found(t)) for i, t, l, _ in reports() if l == lang and i in label]
        for p in ATLAS["phenotypes"]:
            for m in PANEL:
                c = Counter((p in a, m in b) for a, b in rows)
                a, b, e, d = c[False, False], c[False, True], c[True, False], c[True, True]
                if (a + b) * (e + d) * (a + e) * (b + d):
                    want[lang, p, m] = (a, b, e, d)
    assert got == want and {k[0] for k in got} >= {"en", "01", None}
    whole = sorted(map(str, first.collect()))
    # p-values of a stratum are corrected together
    for lang in {k[0] for k in want}:
        own = sorted((r for r in first.collect() if r.lang == lang), key=lambda r: r.p)
        for i, r in enumerate(own):
            assert math.isclose(r.adj_p, min(1, min(x.p * len(own) / (k + 1) for k, x in enumerate(own) if k >= i or x.p == r.p)), rel_tol=1e-9)
    again = association_atlas.run(spark, docs, labels, out, ATLAS)
    assert sorted(map(str, again.collect())) == whole


def test_atlas_of_some_strata_leaves_the_others(spark, tmp_path):
    docs, labels, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    spark.createDataFrame(reports(), DOCS).write.parquet(docs)
    spark.createDataFrame(assessed(), "doc_id long, quality int, toxic int").write.parquet(labels)
    before = association_atlas.run(spark, docs, labels, out, ATLAS).collect()
    spark.createDataFrame([(i + 240, "alpha 123", lang, "s1") for i, lang in enumerate(["en"] * 20 + ["fr"] * 20)], DOCS).write.mode("append").parquet(docs)
    spark.createDataFrame([(i + 240, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.mode("append").parquet(labels)
    after = association_atlas.run(spark, docs, labels, out, ATLAS, only=["en"]).collect()
    rest = lambda rows: sorted(str(r) for r in rows if r.lang != "en")
    assert rest(after) == rest(before)
    assert {r.n for r in after if r.lang == "en"} == {r.n + 20 for r in before if r.lang == "en"}
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(docs)
    assert association_atlas.run(spark, docs, labels, out, ATLAS).count() == 0


def watch(spark, tmp_path):
    return surveillance.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), WATCH)


def check_report(rows, part):
    got = {(r.source, r.marker): r for r in rows}
    want = Counter((s, m) for _, t, _, s in part for m in found(t))
    total, multi = Counter(s for *_, s in part), Counter(s for _, t, _, s in part if len(found(t)) >= 2)
    assert {k: r.k for k, r in got.items()} == want
    for (s, m), r in got.items():
        assert (r.n, r.n_multi) == (total[s], multi[s]) and r.lower <= r.prevalence <= r.upper
        of = {}
        for other in PANEL:
            c = Counter((m in found(t), other in found(t)) for _, t, _, x in part if x == s)
            a, b, e, d = c[False, False], c[False, True], c[True, False], c[True, True]
            if other != m and (a + b) * (e + d) * (a + e) * (b + d):
                of[other] = (a * d - b * e) / math.sqrt((a + b) * (e + d) * (a + e) * (b + d))
        assert (r.partner is None) == (not of)
        if of:
            assert math.isclose(of[r.partner], r.partner_phi, abs_tol=1e-12) and math.isclose(abs(r.partner_phi), max(map(abs, of.values())), abs_tol=1e-12)


def test_surveillance_of_growing_input(spark, tmp_path):
    """Two runs over a growing folder, one without anything new, and one after a lost commit."""
    (tmp_path / "in").mkdir()
    assert watch(spark, tmp_path).count() == 0
    rows = reports()
    at = lambda a, b: spark.createDataFrame(rows[a:b], DOCS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    at(0, 90)
    check_report(watch(spark, tmp_path).collect(), rows[:90])
    counts = lambda: sorted(p.name for p in (tmp_path / "out/counts").glob("batch=*"))
    assert counts() == ["batch=0", "batch=1"]  # three files, two a batch
    at(90, 240)
    second = watch(spark, tmp_path)
    check_report(second.collect(), rows)
    assert counts() == [f"batch={i}" for i in range(4)]
    kept = sorted(map(str, second.collect()))
    assert sorted(map(str, watch(spark, tmp_path).collect())) == kept
    # a run that died after it wrote its counts: the batch is taken again, into the same partition
    for p in (tmp_path / "checkpoint/commits").glob("*3*"):
        p.unlink()
    assert sorted(map(str, watch(spark, tmp_path).collect())) == kept and len(counts()) == 4


def test_configuration(tmp_path):
    bad = tmp_path / "c.json"
    bad.write_text(json.dumps({**ATLAS, "phenotypes": {"mark_a": "toxic = 1"}}))
    with pytest.raises(ValueError):
        association_atlas.load_config(bad)
    bad.write_text(json.dumps({**WATCH, "panel": {surveillance.MULTIPLE: "x"}}))
    with pytest.raises(ValueError):
        surveillance.load_config(bad)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables aren't here")
def test_queries_leave_settings_alone(spark, sf):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    for query in registered.QUERIES.values():
        assert query(spark, sf).count() > 0
    assert spark.conf.get(key) == before and not spark.streams.active


def test_command_lines(tmp_path):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the test tables aren't here")
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "t", ignore=lambda _, names: [n for n in names if n not in ("documents.parquet", "labels.parquet")])
    env = {**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    docs = str(tmp_path / "t/documents.parquet")
    for job in (["association_atlas", "--documents", docs, "--labels", str(tmp_path / "t/labels.parquet"), "--output", str(tmp_path / "a")],
                ["surveillance", "--documents", docs + "*", "--output", str(tmp_path / "b"), "--checkpoint", str(tmp_path / "c")]):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job[0]}", *job[1:]], cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-3000:]
        assert "read " in done.stderr and "wrote " in done.stderr
    assert list((tmp_path / "a").glob("lang=*")) and list((tmp_path / "b/report").glob("source=*"))
