"""Counts and tests of feature pairs inside strata (laboratories, regions, languages), mergeable over batches.

``cell_counts`` are sums over rows, so the counts of several batches of rows add up
(``merged``) to those of all rows; everything after works on counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import pairs


def _one(a: Column | None, b: Column | None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(text(a).alias("item1"), text(b).alias("item2"))


def cell_counts(rows: DataFrame, by: list[str], left: str, right: str | None = None, weight: str | None = None) -> DataFrame:
    """by, item1, item2, n: rows of each stratum (no items), those with an item (item1), and those with a pair.

    ``left`` is an array of names; pairs are two of them in order of the names or, if
    ``right`` is given, one of each (names of both have to differ).  A row counts ``weight`` times.  A row's cells are made
    inside the row and summed before the exchange, so what is exchanged is at most a row
    for each stratum and cell and task, however large a stratum is.
    """
    have = F.array_sort(F.array_distinct(left))
    if right is None:
        two = F.flatten(F.transform(have, lambda a, i: F.transform(F.slice(have, i + 2, F.size(have)), lambda b: _one(a, b))))
        one = F.transform(have, lambda a: _one(a, None))
    else:
        other = F.array_sort(F.array_distinct(right))
        two = F.flatten(F.transform(have, lambda a: F.transform(other, lambda b: _one(a, b))))
        one = F.transform(F.concat(have, other), lambda a: _one(a, None))
    cells = F.concat(F.array(_one(None, None)), one, two)
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    return rows.select(*by, times.alias("_times"), F.inline(cells)).groupBy(*by, "item1", "item2").agg(F.sum("_times").alias("n"))


def merged(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by, "item1", "item2").agg(F.sum("n").alias("n"))


def prevalence(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, k, n, prevalence of the features that a stratum has."""
    total = counts.where("item1 is null").select(*by, F.col("n").alias("_n"))
    one = counts.where("item1 is not null and item2 is null").select(*by, F.col("item1").alias("feature"), F.col("n").alias("k"))
    return _with(one, total, by).select(*by, "feature", "k", F.col("_n").alias("n"), (F.col("k") / F.col("_n")).alias("prevalence"))


def _with(left: DataFrame, right: DataFrame, by: list[str], *more: str, how: str = "inner") -> DataFrame:
    """Joined on the strata (a null is a stratum of its own) and the further columns."""
    other = right.select(*[F.col(c).alias(f"_{c}_") if c in (*by, *more) else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(other[f"_{c}_"]) for c in by] + [left[c] == other[f"_{c}_"] for c in more]
    return left.join(other, same, how).drop(*[f"_{c}_" for c in (*by, *more)])


def contingency(counts: DataFrame, by: list[str], left: list[str] | None = None) -> DataFrame:
    """Tables of all pairs of features that vary in their stratum: by, item1, item2, k1, k2, n, n00, n01, n10, n11.

    ``left``: the names of the first side, where pairs are of one of them and one other.
    The tables are as many as a stratum has pairs of features, whatever its rows.
    """
    p = prevalence(counts, by).where("k < n")
    a = p.select(*by, F.col("feature").alias("item1"), F.col("k").alias("k1"), "n")
    b = p.select(*by, F.col("feature").alias("item2"), F.col("k").alias("k2"))
    if left is not None:
        a, b = a.where(F.col("item1").isin(left)), b.where(~F.col("item2").isin(left))
    every = _with(a, b, by)
    every = every if left is not None else every.where("item1 < item2")
    joint = counts.where("item2 is not null").withColumnRenamed("n", "_joint")
    n11 = F.coalesce("_joint", F.lit(0)).cast("long")
    full = _with(every, joint, by, "item1", "item2", how="left")
    return full.select(*by, "item1", "item2", "k1", "k2", "n", (F.col("n") - F.col("k1") - F.col("k2") + n11).alias("n00"), (F.col("k2") - n11).alias("n01"), (F.col("k1") - n11).alias("n10"), n11.alias("n11"))


def associations(counts: DataFrame, by: list[str], left: list[str] | None = None, method: str = "fdr_bh") -> DataFrame:
    """The tables with phi, chi2, p, test and adj_p, corrected over the pairs of each stratum."""
    return pairs.adjust(pairs.tested(contingency(counts, by, left)), method=method, by=tuple(by))


def odds_ratio() -> Column:
    """Of a table's four counts, a half added to each, so that it is finite."""
    a, b, c, d = (F.col(x) + 0.5 for x in ("n00", "n01", "n10", "n11"))
    return a * d / (b * c)
