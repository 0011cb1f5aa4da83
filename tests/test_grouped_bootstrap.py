"""Bootstrap of grouped statistics by row weights, against plain numpy with the same draws."""

import random

import numpy as np
import pytest

from cohortlens.functions import draws
from cohortlens.operators import bootstrap


def groups():
    r = random.Random(8)
    rows = [("many", i, round(r.gauss(5, 2), 1)) for i in range(400)]  # with ties
    rows += [("far", 1000 + i, 1e9 + r.random()) for i in range(60)]
    rows += [("one", 2000, 3.0), ("same", 2001, 7.0), ("same", 2002, 7.0), ("null", 2003, None), (None, 2004, 1.0), ("many", 2005, None)]
    return rows


def brute(rows, statistic, replicates, seed=42):
    out = {}
    for name in {n for n, _, v in rows if n is not None and v is not None}:
        x = np.array([v for n, _, v in rows if n == name and v is not None])
        key = np.array([i for n, i, v in rows if n == name and v is not None])
        weight = np.searchsorted(draws.POISSON, draws.unit(key[:, None], np.arange(replicates)[None, :], seed).ravel()).reshape(len(x), replicates)
        f = {"mean": np.mean, "median": np.median, "std": np.std}[statistic]
        reps = [f(np.repeat(x, w)) for w in weight.T if w.sum()]
        out[name] = (f(x), *np.percentile(reps, [2.5, 97.5]))
    return out


@pytest.mark.parametrize("statistic", bootstrap.STATISTICS)
@pytest.mark.parametrize("cuts, kept", [(256, 2048), (4, 1)])
def test_by_brute_force(spark, monkeypatch, statistic, cuts, kept):
    monkeypatch.setattr(bootstrap, "CUTS", cuts)
    monkeypatch.setattr(bootstrap, "KEPT_KEYS", kept)
    rows = groups()
    df = spark.createDataFrame(rows, "name string, row long, value double").repartition(3)
    got = {r.name: (r.estimate, r.lower, r.upper) for r in bootstrap.grouped_statistic(df, statistic, 200).collect()}
    want = brute(rows, statistic, 200)
    assert got.keys() == want.keys()
    for name in want:
        assert np.allclose(got[name], want[name], rtol=1e-12, atol=1e-6 if name == "far" else 1e-9), name


def test_no_values(spark):
    df = spark.createDataFrame([("a", 1, None)], "name string, row long, value double")
    assert bootstrap.grouped_statistic(df, "median", 10).count() == bootstrap.grouped_statistic(df.where("false"), "mean", 10).count() == 0
