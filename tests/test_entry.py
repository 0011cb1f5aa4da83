"""The driver's contract: queries and their twins, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.sources.matrix import star_matrix

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables aren't here")

#: A few of each family; the driver runs them all.
NAMES = ["s3_feature_roles", "p1_class_resistance", "p2_mdr_flags", "a1_contingency", "a3_pattern_frequency", "t1_association_tests", "t3_fisher_tests", "t4_adjusted_p", "t6_phenotype_gene",
         "t8_exact_intervals", "t17_permutation_p", "m3_class_rules", "m5_ordered_pairs", "g1_network_edges", "g5_betweenness", "g6_eigenvector", "g8_row_risk", "t9_bootstrap_ci", "x2_edge_confidence", "y5_synthetic_matrix", "c1_coselection_scores", "w1_percentile_rank"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "phi", "p_value", "edge_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gene_rules_of_any_length(spark, con):
    """By brute force, and the twin too."""
    m = star_matrix(spark, str(SF)).role("gene")
    n, has, times = m.rows.count(), defaultdict(set), Counter()
    for r in m.ones.collect():
        has[r.row].add(r.feature)
    for f in has.values():
        times.update(c for k in range(1, len(f) + 1) for c in combinations(sorted(f), k))
    often = {c: k / n for c, k in times.items() if k >= 0.03 * n}
    assert max(map(len, often)) == 4
    want = {}
    for c, s in often.items():
        for a in (a for k in range(1, len(c)) for a in combinations(c, k)):
            b = tuple(x for x in c if x not in a)
            if s / often[a] / often[b] >= 1:
                want[", ".join(a), ", ".join(b)] = s
    got = {(r.antecedents, r.consequents): r for r in entry.queries()["m4_gene_rules"](spark, str(SF)).collect()}
    assert set(got) == set(want) and all(got[k].support == round(s, 6) for k, s in want.items())
    assert {r[:2] for r in con.execute(entry.oracle_sql()["m4_gene_rules"]).fetchall()} == set(want)


def test_registry_without_the_training_data_subpackage(tmp_path):
    """With its folders gone, and with or without the pipeline, the other queries are there; a present module may fail aloud."""
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "cohortlens", tmp_path / "cohortlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    script = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    first = run()
    assert first.stdout.split()[-1:] == ["False"] and int(first.stdout.split()[0]) > 90, first.stderr
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run().stdout == first.stdout
    (tmp_path / "cohortlens/llm").mkdir()
    (tmp_path / "cohortlens/llm/__init__.py").write_text("")
    (tmp_path / "cohortlens/llm/queries.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr
