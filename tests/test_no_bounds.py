"""What earlier had a bound: large tables of a report, long rules; and the corrections for many tests."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import mining, ordering, pairs, report


def test_large_tables_are_written_whole(spark, tmp_path):
    df = spark.range(120_500).select(F.col("id").alias("x")).orderBy(F.desc("x"))
    rows, note = report.shown(df, f"{tmp_path}/all")
    assert len(rows) == report.MOST and rows["x"][0] == 120_499
    assert "100000 of 120500" in note and spark.read.parquet(f"{tmp_path}/all").count() == 120_500
    assert report.shown(df.limit(3), f"{tmp_path}/none")[1] == "" and not (tmp_path / "none").exists()


def test_rules_of_long_sets(spark, monkeypatch):
    """Item by item as by masks, and above 31 items too."""
    sets = [list("abcdef"), list("xyz"), ["p", "q"]]
    df = spark.createDataFrame([(s, 0.5) for s in sets], "items array<string>, support double")
    want = sorted((list(c), [x for x in s if x not in c]) for s in sets for k in range(1, len(s)) for c in itertools.combinations(s, k))
    for most in (12, 2):
        monkeypatch.setattr(mining, "AT_ONCE", most)
        got = sorted(([*r.antecedents], [*r.consequents]) for r in mining._divided(df).collect())
        assert got == want
    monkeypatch.setattr(mining, "AT_ONCE", 12)
    known = [c for k in (1, 2, 3, 13) for c in itertools.combinations([f"i{n:02d}" for n in range(13)], k)]
    rules = mining.association_rules(spark.createDataFrame([(list(c), 0.5) for c in known], "items array<string>, support double"), 0.0)
    # 13 items part into known halves of two sizes only: none; smaller sets in all ways
    assert rules.count() == 78 * 2 + 286 * 6


def brute(p, method, alpha=0.05):
    """Adjusted values of sorted p."""
    m = len(p)
    bh = [min(1, min(p[k] * m / (k + 1) for k in range(i, m))) for i in range(m)]
    if method in ("fdr_tsbh", "fdr_tsbky"):
        f = 1 + alpha if method == "fdr_tsbky" else 1
        gone = sum(x <= alpha / f for x in bh)
        return [min(1, x * f * (1 if gone in (0, m) else (m - gone) / m)) for x in bh]
    return {"bonferroni": [min(1, x * m) for x in p], "sidak": [1 - (1 - x) ** m for x in p], "holm": [min(1, max(p[k] * (m - k) for k in range(i + 1))) for i in range(m)],
            "holm-sidak": [max(1 - (1 - p[k]) ** (m - k) for k in range(i + 1)) for i in range(m)], "simes-hochberg": [min(1, min(p[k] * (m - k) for k in range(i, m))) for i in range(m)],
            "fdr_bh": bh, "fdr_by": [min(1, min(p[k] * m / (k + 1) for k in range(i, m)) * sum(1 / k for k in range(1, m + 1))) for i in range(m)]}[method]


@pytest.mark.parametrize("method", pairs.METHODS)
def test_corrections(spark, monkeypatch, method):
    r = random.Random(1)
    groups = {g: sorted(r.choice((0.0, 1.0, 0.5, r.random() ** 6, r.random())) for _ in range(n)) for g, n in (("a", 90), ("b", 30), ("c", 1))}
    rows = [(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g string, item1 long, p double")
    close = lambda got, want: all(abs(got[k] - w) < 1e-12 for k, w in enumerate(want))
    split = pairs.adjust(df, method=method, ties=("item1",), by=("g",)).collect()
    for g, ps in groups.items():
        assert close({x.item1: x.adj_p for x in split if x.g == g}, brute(ps, method))
    for few in (1 << 18, 7):  # one task, and parts
        monkeypatch.setattr(ordering, "ONE_TASK", few)
        one = pairs.adjust(df.where("g = 'a'"), method=method, ties=("item1",)).collect()
        assert close({x.item1: x.adj_p for x in one}, brute(groups["a"], method))
