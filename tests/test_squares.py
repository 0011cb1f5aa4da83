"""Pairs of few columns are counted by squares of a task's rows, and risks without an exchange."""

from pyspark.sql import functions as F

from cohortlens.operators import graph, pairs
from cohortlens.sources import matrix


def made(spark):
    rows = [(i, [f for k, f in enumerate(("b", "a", "c'", "é")) if i % (k + 2) == 0] if i % 5 else []) for i in range(9000)]
    df = spark.createDataFrame(rows, "row long, has array<string>").repartition(3)
    return matrix.packed(df, spark.createDataFrame([(f, "gene", i, None) for i, f in enumerate(("b", "a", "c'", "é", "never"))], matrix.FEATURES))


def test_squares_are_the_cells(spark, monkeypatch):
    m = made(spark)
    new = pairs.cells(m)
    assert "MapInArrow" in new._jdf.queryExecution().toString()
    got = {tuple(r) for r in new.collect()}
    assert {tuple(r) for r in pairs.cells(matrix.packed(m.arrays.limit(0), m.features)).collect()} == set()
    monkeypatch.setattr(pairs, "few_features", lambda _: False)
    assert got == {tuple(r) for r in pairs.cells(m).collect()} and len(got) > 5


def test_risk_by_arrays(spark):
    m = made(spark)
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("é", None)], "id string, node_score double")
    plain = matrix.BinaryMatrix(m.ones, m.rows, m.features)
    a, b = graph.row_risk(m, scores), graph.row_risk(plain, scores)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() == 9000
    none = graph.row_risk(m, scores.where(F.lit(False)))
    assert none.agg(F.max("risk")).first()[0] == 0 and none.count() == 9000
