"""Row draws: the fast form is the plain one, they are made once, and what is handed on grows with patterns, not with rows."""

import numpy as np
import pytest

from cohortlens.functions import draws
from cohortlens.operators import advanced, bootstrap
from cohortlens.sources import matrix

ROLES = [("a", "gene", 0, None), ("b", "gene", 1, None), ("c", "gene", 2, None)]


def made(spark, many=3000):
    rows = [(i, [f for k, f in enumerate("abc") if i % (k + 2) == 0] if i % 5 else []) for i in range(many)]
    df = spark.createDataFrame(rows, "row long, has array<string>").repartition(6)
    return rows, matrix.packed(df, spark.createDataFrame(ROLES, matrix.FEATURES))


def plain(key, replicates, seed):
    return np.searchsorted(draws.POISSON, draws.unit(key[:, None], np.arange(replicates)[None, :], seed).ravel()).reshape(len(key), replicates)


@pytest.mark.parametrize("seed", [0, 7, 42])
def test_fast_draws(seed):
    p = draws.PRIME
    key = np.r_[np.arange(500), p * np.arange(20), p * np.arange(1, 20) - 1, 2**63 - 1, np.random.default_rng(seed).integers(0, 2**63 - 1, 2000)].astype(np.int64)
    assert (draws.poisson(key, 300, seed) == plain(key, 300, seed)).all()


def spied(monkeypatch):
    kept = []
    real = bootstrap.settled
    monkeypatch.setattr(bootstrap, "settled", lambda df: kept.append(real(df)) or kept[-1])
    return kept


def test_resamples_by_brute_force_with_one_array_a_pattern(spark, monkeypatch):
    rows, m = made(spark)
    kept = spied(monkeypatch)
    got = {(r.replicate, tuple(r.has)): r.n for r in bootstrap.resamples(m, 20).collect()}
    weight, want = plain(np.array([i for i, _ in rows]), 20, 42), {}
    for (_, has), w in zip(rows, weight):
        for b, n in enumerate(w.tolist()):
            if n:
                want[b, tuple(has)] = want.get((b, tuple(has)), 0) + n
    assert got == want
    patterns, parts = len({tuple(h) for _, h in rows}), kept[-1]
    assert "at_end" in parts.columns and parts.count() <= patterns + 2 * 4  # 4 tasks: at most two ends each


def test_draws_are_made_once(spark):
    _, m = made(spark, 200)
    for df in (bootstrap.joint_intervals(m, 10), advanced.pattern_stability(m, 0.3, 10), advanced.network_confidence(m, 10)):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()


def test_medians_cut_ranges_again(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CUTS", 8)
    kept = spied(monkeypatch)
    values = spark.createDataFrame([("x", i, float(i * i % 10007)) for i in range(4000)], "name string, row long, value double")
    out = bootstrap.grouped_statistic(values, "median", 50).collect()
    assert len(out) == 1
    ranged = [t for t in kept if t.columns == ["number", "row", "value", "range"]][-1]
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 2 * 4000 / 64
