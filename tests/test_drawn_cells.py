"""Generated cells: digests compared as text, one row at a time over all tasks."""

import hashlib

from cohortlens.functions import draws
from cohortlens.operators import synth


def test_limits_are_the_draws_order():
    for p in (0.0, 1e-17, 0.05, 0.35, 0.5, 0.95, 1 - 2**-53, 1.0, 2 / 3):
        for i in range(300):
            digits = hashlib.md5(f"42|{i}".encode()).hexdigest()[:13]
            assert (digits < draws.limit_md5(p)) == (draws.unit_md5(42, i) < p)
    edge = draws.unit_md5(42, 1)
    digits = hashlib.md5(b"42|1").hexdigest()[:13]
    assert not digits < draws.limit_md5(edge) and digits < draws.limit_md5(edge + 2**-53)


def test_cells_by_brute_force_and_dealt_out(spark):
    rows = spark.range(40).selectExpr("cast(id AS string) AS row").coalesce(1)
    m, truth = synth.synthetic_matrix(spark, rows=rows, seed=5)
    u = lambda *x: draws.unit_md5(5, *x)
    p, want = truth["prevalences"], set()
    tied = {g: (d, rho) for (d, g), rho in truth["correlations"].items()}
    for r in map(str, range(40)):
        for f in p:
            chance = p[f]
            if f in tied:
                d, rho = tied[f]
                chance = min(0.95, p[f] + rho * (1 - p[f])) if u(d, r) < p[d] else max(0.05, p[f] - rho * p[f])
            if (u(f, r) < chance) != (u(f + "/noise", r) < 0.05):
                want.add((r, f))
    assert {tuple(x) for x in m.ones.collect()} == want
    assert m.ones.rdd.getNumPartitions() > 1  # one file's rows don't stay one task
