"""Tile pyramids and pages against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import pages, tiles


def test_interleaving(spark):
    r = random.Random(2)
    pairs = [(0, 0), (1, 0), (0, 1), (2**20 - 1, 2**20 - 1)] + [(r.randrange(2**20), r.randrange(2**20)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "x long, y long").withColumn("k", tiles.interleaved(F.col("x"), F.col("y")))
    x, y = tiles.parted(F.col("k"))
    for row in df.select("x", "y", "k", x.alias("a"), y.alias("b")).collect():
        assert (row.a, row.b) == (row.x, row.y)
        assert row.k == sum((row.x >> i & 1) << 2 * i | (row.y >> i & 1) << 2 * i + 1 for i in range(20))


@pytest.mark.parametrize("finest, levels", [(5, None), (4, 2), (0, None)])
def test_pyramid_by_brute_force(spark, finest, levels):
    r = random.Random(3)
    points = [(r.gauss(0, 3), r.random() ** 3, r.choice(("a", "b", None)), float(r.randint(0, 9))) for _ in range(300)]
    odd = [(None, 1.0, "a", 1.0), (1.0, float("nan"), "a", 1.0)]
    found = tiles.pyramid(spark.createDataFrame(points + odd, "x double, y double, c string, v double"), "x", "y", "c", "v", finest, levels).collect()
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    at = lambda v, all_: min(int((v - min(all_)) / (max(all_) - min(all_)) * 2**finest), 2**finest - 1)
    want = collections.defaultdict(lambda: [0, 0.0])
    for x, y, c, v in points:
        for up in range(finest + 1 if levels is None else levels):
            cell = want[finest - up, at(x, xs) >> up, at(y, ys) >> up, c]
            cell[0] += 1
            cell[1] += v
    assert {(t.level, t.tile_x, t.tile_y, t.category): [t.n, t.total] for t in found} == want


def test_pyramid_of_few_points(spark):
    same = spark.createDataFrame([(2.0, 5.0)] * 3, "x double, y double")
    assert [(t.level, t.tile_x, t.tile_y, t.n, t.total) for t in tiles.pyramid(same, "x", "y", finest=1).collect()] == [(1, 0, 0, 3, None), (0, 0, 0, 3, None)]
    assert tiles.pyramid(same.where("false"), "x", "y").count() == 0
    spread = spark.createDataFrame([(float(i), float(i)) for i in range(8)], "x double, y double")
    assert {t.tile_x for t in tiles.view(tiles.pyramid(spread, "x", "y", finest=3), 3, 2, 4, 0, 3).collect()} == {2, 3}
    with pytest.raises(ValueError):
        tiles.pyramid(same, "x", "y", finest=21)


def test_pages(spark, tmp_path):
    df = spark.range(103).select((F.col("id") * 37 % 103).alias("x"), F.lit("é").alias("a b"))
    book = pages.paged(df, [F.desc("x")], str(tmp_path / "book"), parts=7)
    assert book.rows == 103 and len(book.parts) > 3
    got = [r.x for k in range(1, 12) for r in book.page(k, 10).collect()]
    assert got == list(range(102, -1, -1))
    assert book.page(12, 10).count() == 0 and book.parts_of(12, 10) == []
    assert max(len(book.parts_of(k, 1)) for k in range(1, 104)) == 1
    assert "PartitionFilters: [isnotnull" in (plan := book.page(50, 1)._jdf.queryExecution().executedPlan().toString()) or "_part" in plan
    with pytest.raises(ValueError):
        book.page(0, 10)
    assert pages.paged(df.where("false"), [F.asc("x")], str(tmp_path / "none")).page(1, 5).count() == 0
