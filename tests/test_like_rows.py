"""Itemsets are mined from rows that lie beside their like."""

from pyspark.sql import functions as F

from cohortlens.operators import mining
from cohortlens.sources import matrix


def test_like_rows_lie_together(spark, monkeypatch):
    rows = [(i, [f for k, f in enumerate("dcba") if i % (k + 2) == 0]) for i in range(6000)]
    df = spark.createDataFrame(rows, "row long, has array<string>").repartition(6)
    m = matrix.packed(df, spark.createDataFrame([(f, "gene", i, None) for i, f in enumerate("dcba")], matrix.FEATURES))
    kept = []
    real = mining.settled
    monkeypatch.setattr(mining, "settled", lambda x: kept.append(real(x)) or kept[-1])
    got = {tuple(r["items"]): r.n for r in mining.frequent_itemsets(m, 0.001).collect()}
    for s, n in got.items():
        assert n == sum(set(s) <= set(has) for _, has in rows)
    mined = next(t for t in kept if t.columns == ["items"])
    places = mined.select(F.sort_array("items").alias("items"), F.input_file_name().alias("at"))
    files, patterns = places.select("at").distinct().count(), places.select("items").distinct().count()
    assert mined.count() == 6000 and places.distinct().count() <= patterns + files
