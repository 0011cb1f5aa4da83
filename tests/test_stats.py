"""Column expressions of 2x2 tables against direct arithmetic."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import stats, text


def one(spark, cells, f):
    df = spark.createDataFrame([cells], "a long, b long, c long, d long")
    return df.select(f(*[F.col(x) for x in "abcd"]).alias("x")).first()["x"]


def fisher(a, b, c, d):
    r, k, n = c + d, b + d, a + b + c + d
    pmf = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
    return min(1.0, sum(pmf(x) for x in range(max(0, r + k - n), min(r, k) + 1) if pmf(x) <= pmf(d) * (1 + 1e-7)))


@pytest.mark.parametrize("cells,phi", [((50, 0, 0, 50), 1.0), ((0, 50, 50, 0), -1.0), ((25, 25, 25, 25), 0.0), ((10, 0, 5, 0), None), ((0, 0, 0, 0), None)])
def test_phi(spark, cells, phi):
    got = one(spark, cells, stats.phi)
    assert got == (pytest.approx(phi) if phi is not None else None)


def test_yates_and_tail(spark):
    got = one(spark, (50, 30, 20, 40), stats.association)
    want = sum((max(abs(o - e) - 0.5, 0)) ** 2 / e for o, e in ((50, 40), (30, 40), (20, 30), (40, 30)))
    want = 140 * (abs(50 * 40 - 30 * 20) - 70) ** 2 / (80 * 60 * 70 * 70)
    assert got["chi2"] == pytest.approx(want) and got["test"] == "chi2"
    assert got["p"] == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-12)


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (2, 1, 1, 2), (40, 1, 1, 4), (300, 20, 2, 3), (7, 0, 0, 2)])
def test_fisher(spark, cells):
    got = one(spark, cells, stats.association)
    assert got["test"] == "fisher" and got["p"] == pytest.approx(fisher(*cells), rel=1e-9)
    assert got["chi2"] == pytest.approx(got["phi"] ** 2 * sum(cells))


def test_upper_tail(spark):
    a, b, c, d = 40, 10, 6, 9
    r, k, n = c + d, b + d, a + b + c + d
    want = sum(math.comb(k, x) * math.comb(n - k, r - x) for x in range(d, min(r, k) + 1)) / math.comb(n, r)
    assert one(spark, (a, b, c, d), stats.upper_tail_p) == pytest.approx(want, rel=1e-9)


def test_erfc_and_factorials(spark):
    z = [0.0, 1e-8, 0.1, 1.0, 2.4999, 2.5, 4.0, 6.0, 10.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.erfc(F.col("z"))).collect()]
    for x, y in zip(z, got):
        assert y == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-300)
    k = [0, 1, 5, 31, 32, 33, 1000, 10**9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in k], "k long").select(stats.ln_factorial(F.col("k"))).collect()]
    for x, y in zip(k, got):
        assert y == pytest.approx(math.lgamma(x + 1), rel=1e-12, abs=1e-12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 40)] * 4), min_size=1, max_size=20))
def test_association_bounds(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in df.select("*", stats.association(*[F.col(x) for x in "abcd"]).alias("t"), stats.plain_chi2(*[F.col(x) for x in "abcd"]).alias("x2")).collect():
        t, full = r["t"], min(r.a + r.b, r.c + r.d, r.a + r.c, r.b + r.d) > 0
        assert (t["phi"] is not None) == full
        if full:
            assert -1 - 1e-12 <= t["phi"] <= 1 + 1e-12 and 0 <= t["p"] <= 1 and r.x2 == pytest.approx(t["phi"] ** 2 * (r.a + r.b + r.c + r.d), abs=1e-9)
        else:
            assert t["p"] is None and r.x2 == 0


def test_stars_and_sheet_names(spark):
    df = spark.createDataFrame([(0.0004,), (0.004,), (0.04,), (0.4,), (None,)], "p double")
    assert [r[0] for r in df.select(stats.stars(F.col("p"))).collect()] == ["0.000 ***", "0.004 **", "0.040 *", "0.400", ""]
    assert spark.createDataFrame([("a:b/c[d]*?\\" + "x" * 40,)], "s string").select(text.sheet_name(F.col("s"))).first()[0] == "a_b_c_d____" + "x" * 20
