"""Matrices with one array for each row: wide rows, and agreement with the form of ones."""

import collections
import itertools
import random

from cohortlens.operators import mining, pairs, resistance
from cohortlens.sources import matrix


def test_wide_rows(spark, monkeypatch):
    """Rows of more features than a block are dealt out by pairs of blocks: the same counts."""
    r = random.Random(5)
    names = [f"f{i:04d}" for i in range(700)]
    rows = [(k, r.sample(names, size)) for k, size in enumerate((0, 1, 600, 40, 513, 512, 700))]
    arrays = spark.createDataFrame(rows, "row long, has array<string>")
    m = matrix.packed(arrays, spark.createDataFrame([(n, "gene", i, None) for i, n in enumerate(reversed(names))], matrix.FEATURES))
    want = collections.Counter()
    for _, has in rows:
        want[None, None] += 1
        want.update((a, None) for a in has)
        want.update(itertools.combinations(sorted(has), 2))
    assert {(x.item1, x.item2): x.n for x in pairs.cells(m).collect()} == want
    monkeypatch.setattr(pairs, "BLOCK", 7)
    assert {(x.item1, x.item2): x.n for x in pairs.cells(m).collect()} == want


def test_arrays_and_ones_agree(spark):
    """Every step of a matrix with arrays against the same matrix without."""
    r = random.Random(6)
    drugs = [d for c in matrix.DRUG_CLASSES.values() for d in c]
    names = [*drugs, "g1", "g2", "g3"]
    rows = [(k, r.sample(names, r.randint(0, 9))) for k in range(80)]
    a = matrix.packed(spark.createDataFrame(rows, "row long, has array<string>"), spark.createDataFrame(matrix.feature_roles(names), matrix.FEATURES))
    b = matrix.BinaryMatrix(a.ones, a.rows, a.features)
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    for f in (pairs.prevalence, pairs.contingency, resistance.multiresistance, mining.patterns, lambda m: resistance.mdr_subset(m).ones, lambda m: m.role("gene").ones, lambda m: m.class_level().ones,
              lambda m: pairs.contingency(m, cross_roles=True), resistance.fast_mdr_count, lambda m: mining.patterns(resistance.mdr_subset(m).class_level())):
        assert same(f(a), f(b.with_arrays() if f is mining.patterns else b))
