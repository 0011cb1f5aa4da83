"""p of ordered triplets: by whole numbers, and with one running sum of tails for a pair's margins."""

import math
from fractions import Fraction

import pytest

from cohortlens.operators import mining

SCHEMA = "a string, b string, c string, na long, nb long, nc long, n long, n_ab long, n_bc long"


def exact(na, nb, nc, n, n_ab, n_bc):
    def chance(x, r, k):
        return Fraction(math.comb(r, x) * math.comb(n - r, k - x), math.comb(n, k))

    total = Fraction(0)
    for x in range(max(0, na + nb - n), min(na, nb) + 1):
        for y in range(max(0, nb + nc - n), min(nb, nc) + 1):
            if x * y >= n_ab * n_bc:
                total += chance(x, na, nb) * chance(y, nb, nc)
    return float(total)


def test_by_whole_numbers(spark, monkeypatch):
    kept = []
    real = mining.settled
    monkeypatch.setattr(mining, "settled", lambda df: kept.append(real(df)) or kept[-1])
    cases = [(20, 15, 12, 40, 8, 5), (20, 15, 12, 40, 0, 5), (30, 35, 33, 40, 28, 30), (3, 4, 5, 9, 3, 4), (20, 15, 12, 40, 15, 12), (40, 40, 40, 40, 40, 40), (200, 150, 90, 400, 80, 40), (201, 150, 90, 400, 80, 40)]
    df = spark.createDataFrame([(f"a{i}", "b", "c", *x) for i, x in enumerate(cases)], SCHEMA)
    got = {r.a: r.p for r in mining.chain_p(df).collect()}
    for i, x in enumerate(cases):
        assert got[f"a{i}"] == pytest.approx(exact(*x), rel=1e-9, abs=1e-15), x
    tails = kept[-1]
    assert tails.columns == ["nb", "nc", "n", "y", "tail"]
    assert tails.count() == tails.select("nb", "nc", "n", "y").distinct().count()


def test_large_margins_take_sums_not_tails_for_each_count(spark):
    n = 54_000_000
    df = spark.createDataFrame([("a", "b", "c", n // 4, n // 3, n // 4, n, n // 12, n // 12)], SCHEMA)
    p = mining.chain_p(df).collect()[0].p
    assert 0.49 < p < 0.51  # at the mean: a half
