"""An order's features: known names are bits of one number, and the rows are those of plain sets whatever the names."""

import pytest

from cohortlens.operators import bootstrap
from cohortlens.sources import matrix


def written(spark, folder, strange):
    lines = [(o, p, r, s) for o in range(40) for p, r, s in ((o % 7, "ARN"[o % 3], "OF"[o % 2]), (o % 7, "ARN"[o % 3], "OF"[o % 2]), (o % 11 + 20, None, "O"), (None, "A", "F"))]
    part = [(p, f"Brand#{p % 25 + 1}") for p in range(25)] + [(25, None), (0, "Brand#25")]
    if strange == "brand":
        part.append((26, "Brand#99"))
    if strange == "flag":
        lines.append((3, 1, "X", "Y"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(part, "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    want = {}
    for o, p, r, s in lines:
        has = want.setdefault(o, set())
        has |= {b for k, b in part if k == p and b} | ({f"flag_{r}{s}"} if r and s else set())
    return want


@pytest.mark.parametrize("strange", ["", "brand", "flag"])
def test_rows_are_plain_sets(spark, tmp_path, strange):
    want = written(spark, f"file://{tmp_path}", strange)
    m = matrix.star_matrix(spark, f"file://{tmp_path}")
    got = [(r.row, list(r.has)) for r in m.arrays.collect()]
    assert len(got) == len(want) and all(len(h) == len(set(h)) and set(h) == want[o] for o, h in got)
    plan = m.arrays._jdf.queryExecution().executedPlan().toString()
    assert ("ObjectHashAggregate" in plan) == bool(strange)  # sets that are collected are sorted and spill


def test_sums_by_feature_take_the_rows_as_they_are(spark, tmp_path):
    """One exchange makes the rows; looking features up needs no other, and the sums are those of the ones."""
    written(spark, f"file://{tmp_path}", "")
    m = matrix.star_matrix(spark, f"file://{tmp_path}")
    keys = bootstrap._feature_keys(m)
    plain = bootstrap._feature_keys(matrix.BinaryMatrix(m.ones, m.rows, m.features))
    rows = lambda t: {r.row: sorted(r["keys"]) for r in t.collect()}
    assert rows(keys) == rows(plain)
    assert keys._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the join with parts, and the rows
