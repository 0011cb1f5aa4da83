"""Exact tests at margins of any size, against exact fractions and against each other."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import stats

COUNTS = ["a", "b", "c", "d"]


def exact(a, b, c, d):
    """(two-sided, upper) by whole numbers."""
    r, k, n = c + d, b + d, a + b + c + d
    ways = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
    total = math.comb(n, k)
    return float(Fraction(sum(w for w in ways.values() if w <= ways[d]), total)), float(Fraction(sum(w for x, w in ways.items() if x >= d), total))


def computed(spark, tables, support):
    df = spark.createDataFrame(tables, ", ".join(f"{c} long" for c in COUNTS))
    args = [F.col(c) for c in COUNTS]
    rows = df.select(*COUNTS, stats.fisher_p(*args, whole_support=support).alias("two"), stats.upper_tail_p(*args, whole_support=support).alias("up")).collect()
    return {tuple(r[c] for c in COUNTS): (r.two, r.up) for r in rows}


def close(x, y):
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-300)


@pytest.mark.parametrize("support", [0, stats.WHOLE_SUPPORT])
def test_small_tables_by_whole_numbers(spark, support):
    r = random.Random(1)
    tables = {(r.randint(0, 9), r.randint(0, 9), r.randint(0, 9), r.randint(0, 9)) for _ in range(150)}
    tables |= {(5, 5, 5, 5), (7, 0, 0, 7), (0, 7, 7, 0), (3, 4, 4, 3), (0, 0, 3, 4), (1, 0, 0, 0), (0, 0, 0, 1), (40, 2, 3, 30)}
    tables = sorted(t for t in tables if sum(t))
    got = computed(spark, tables, support)
    for t in tables:
        two, up = exact(*t)
        assert close(got[t][0], two) and close(got[t][1], up), t


def test_middling_tables(spark):
    r = random.Random(2)
    tables = sorted({tuple(r.randint(300, 1500) for _ in COUNTS) for _ in range(12)} | {(1000, 1000, 1000, 1000), (2000, 600, 600, 700), (700, 1400, 1300, 650)})
    got = computed(spark, tables, 0)
    for t in tables:
        two, up = exact(*t)
        assert close(got[t][0], two) and close(got[t][1], up), t


def test_margins_of_a_thousand_millions(spark):
    """Symmetric tables mirror each other, near-independent ones agree with the normal tail, rare pairs with Poisson's."""
    half = 500_000_000
    sd = math.sqrt(1e9**4 / ((2e9) ** 2 * (2e9 - 1)))
    z = [-3, -1, 0, 1, 3]
    shift = [round(x * sd) for x in z]
    tables = [(half + s, half - s, half - s, half + s) for s in shift]
    rare = (10**12 - 2 * 10**6 + 5, 10**6 - 5, 10**6 - 5, 5)
    got = computed(spark, [*tables, rare], stats.WHOLE_SUPPORT)
    normal = lambda x: math.erfc(x / math.sqrt(2)) / 2
    for t, s in zip(tables, shift):
        two, up = got[t]
        assert math.isclose(up, normal((s - 0.5) / sd), rel_tol=1e-6)
        assert math.isclose(two, min(1, 2 * normal((abs(s) - 0.5) / sd)), rel_tol=1e-6)
    assert math.isclose(got[tables[0]][0], got[tables[4]][0], rel_tol=1e-9)
    poisson = [math.exp(-1) / math.factorial(x) for x in range(40)]
    assert math.isclose(got[rare][1], sum(poisson[5:]), rel_tol=1e-4)
    assert math.isclose(got[rare][0], sum(p for p in poisson if p <= poisson[5]), rel_tol=1e-4)
