"""Checks of generated tables, summaries of pattern stores, timing, and the package's names."""

import statistics

import pytest

import cohortlens
from cohortlens.operators import patterns, validation
from cohortlens.plans import measure


def test_check_of_a_generated_table(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 0, 0), (3, 1, 0, 0), (4, 0, 1, 0)], "id int, a int, b int, mdr int")
    good = validation.check_synthetic(df, {"a": 0.5, "b": 0.25}, 4, "mdr")
    assert good == {"passed": True, "errors": [], "warnings": [], "mdr_share": 0.25}
    # relative to what was expected: .25 is off by a quarter of .2, and by two thirds of .15
    assert not validation.check_synthetic(df, {"b": 0.2}, 4)["warnings"] and validation.check_synthetic(df, {"b": 0.15}, 4)["warnings"]
    wrong = validation.check_synthetic(df, {"a": 0.5, "gone": 0.1}, 5)
    assert not wrong["passed"] and len(wrong["errors"]) == 2 and wrong["mdr_share"] is None
    odd = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, `x.y` int")
    assert validation.check_synthetic(odd, {"x.y": 1.5}, 3)["warnings"] == ["x.y: 2 values are neither 0 nor 1"]
    assert validation.check_synthetic(df.limit(0), {"a": 0.5}, 0, "mdr") == {"passed": True, "errors": [], "warnings": [], "mdr_share": None}


def test_pattern_summary(spark):
    values = [0.1, 0.4, 0.4, 0.9, 0.95]
    df = spark.createDataFrame([(x, 1 - x, None if x > 0.9 else 2 * x) for x in values], "support double, confidence double, lift double")
    got = {r.column: r for r in patterns.pattern_summary(df).collect()}
    for name, want in (("support", values), ("confidence", [1 - x for x in values]), ("lift", [2 * x for x in values[:4]])):
        q1, q2, q3 = statistics.quantiles(want, n=4, method="inclusive")
        assert tuple(got[name])[1:] == pytest.approx((len(want), statistics.mean(want), statistics.stdev(want), min(want), q1, q2, q3, max(want)))
    assert patterns.pattern_summary(df.limit(0)).count() == 0


def test_timing_and_status(spark):
    took = measure.measured(lambda n: spark.range(n), 1000, n_runs=3)
    assert took["n_runs"] == 3 and 0 < took["min_ms"] <= took["mean_ms"] <= took["max_ms"]
    with pytest.raises(ValueError):
        measure.measured(lambda: spark.range(1), n_runs=0)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        status = measure.session_status(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert status["adaptive_plans"] and not status["skew_joins"] and status["shared_folder"]


def test_names_of_the_package():
    assert all(getattr(cohortlens, name) is not None for name in cohortlens.__all__)
    with pytest.raises(AttributeError):
        cohortlens.no_such_name
