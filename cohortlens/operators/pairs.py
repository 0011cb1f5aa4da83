"""Pairs of features: joint counts, tests of association, correction for many tests.

All counts need one pass: a row's features are an array, its pairs are made inside the
row, and counted with a partial sum on the map side (see ``cells``).  No pair of features
costs a scan, and no join runs over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from ..sources.matrix import BinaryMatrix, few_features
from ..sources.shared import settled
from . import ordering


#: Features of a row whose pairs are made at once; those of more are dealt out by pairs of such blocks.
BLOCK = 512
#: Rows of a task that are multiplied at once.
AT_ONCE = 4096


def _squares(m: BinaryMatrix) -> DataFrame:
    """``cells`` of few columns: a task's rows, as 0 and 1, times themselves, added up in one square that it hands on."""

    def run(batches):
        names, total, rows = {}, np.zeros((0, 0), np.int64), 0
        for batch in batches:
            has = batch.column(0)
            rows += len(has)
            flat, many = pc.dictionary_encode(has.flatten()), has.value_lengths().to_numpy()
            at = np.array([names.setdefault(x, len(names)) for x in flat.dictionary.to_pylist()], np.int64)
            place, owner = at[flat.indices.to_numpy()], np.repeat(np.arange(len(many)), many)
            grown = np.zeros((len(names), len(names)), np.int64)
            grown[: len(total), : len(total)] = total
            total, first = grown, np.r_[0, np.cumsum(many)]
            for begin in range(0, len(many), AT_ONCE):
                end = min(len(many), begin + AT_ONCE)
                one = np.zeros((end - begin, len(names)), np.float32)
                some = slice(first[begin], first[end])
                one[owner[some] - begin, place[some]] = 1
                total += (one.T @ one).astype(np.int64)  # below 2**24: exact in single precision
        order = sorted(range(len(names)), key=list(names).__getitem__)
        label, square = sorted(names), total[np.ix_(order, order)]
        a, b = np.nonzero(np.triu(square))
        item1, item2 = [None, *[label[i] for i in a]], [None, *[label[j] if i != j else None for i, j in zip(a, b)]]
        yield pa.RecordBatch.from_arrays([pa.array(item1, pa.string()), pa.array(item2, pa.string()), pa.array([rows, *square[a, b].tolist()], pa.int64())], ["item1", "item2", "n"])

    parts = m.by_row().select("has").mapInArrow(run, "item1 string, item2 string, n long")
    return parts.where("n > 0").groupBy("item1", "item2").agg(F.sum("n").alias("n"))


def cells(m: BinaryMatrix) -> DataFrame:
    """item1, item2, n: rows of the matrix (no items), with a feature (item1), and with two (item1 < item2).

    A row's cells are made inside the row and summed before the exchange.  A row with more
    than ``BLOCK`` features gives pairs of blocks instead; these are dealt over the tasks
    by the first sum and multiplied out afterwards, so no task holds all pairs of a row.
    Where the matrix has few columns a task adds up one square of them instead.
    """
    if few_features(m.features):
        return _squares(m)
    text, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    cell = lambda a=text, b=text, left=texts, right=texts: F.struct(a.alias("item1"), b.alias("item2"), left.alias("left"), right.alias("right"))
    rows = m.by_row().select(F.array_sort("has").alias("f"))
    size = F.size("f")
    after = lambda a, i: F.slice("f", i + 2, F.greatest(size, F.lit(1)))
    two = F.flatten(F.transform("f", lambda a, i: F.transform(after(a, i), lambda b: cell(a, b))))
    block = lambda i: F.slice("f", i * BLOCK + 1, F.lit(BLOCK))
    last = F.floor((size - 1) / BLOCK).cast("int")
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: cell(left=block(i), right=block(j)))))
    made = F.concat(F.array(cell()), F.transform("f", lambda a: cell(a)), F.when(size > BLOCK, blocks).otherwise(two))
    first = rows.select(F.inline(made)).groupBy("item1", "item2", "left", "right").agg(F.count("*").alias("n"))
    pair = lambda a, b: F.struct(a.alias("item1"), b.alias("item2"))
    out = F.flatten(F.transform("left", lambda a: F.transform(F.filter("right", lambda b: a < b), lambda b: pair(a, b))))
    every = first.select(F.inline(F.when(F.col("left").isNull(), F.array(pair(F.col("item1"), F.col("item2")))).otherwise(out)), "n")
    return every.groupBy("item1", "item2").agg(F.sum("n").alias("n"))


def _prevalence(m: BinaryMatrix, found: DataFrame, *more: str) -> DataFrame:
    """Of ``cells``, or of those of single features."""
    k = found.where("item1 is not null and item2 is null").select(F.col("item1").alias("feature"), F.col("n").alias("k"))
    n = found.where("item1 is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    full = m.features.join(F.broadcast(k), "feature", "left").crossJoin(F.broadcast(n))
    k0 = F.coalesce("k", F.lit(0)).cast("long")
    return full.select("feature", "ord", *more, k0.alias("k"), "n", F.when(F.col("n") > 0, k0 / F.col("n")).otherwise(0.0).alias("prevalence"))


def prevalence(m: BinaryMatrix) -> DataFrame:
    """``feature, ord, k, n, prevalence`` of all features, those without ones included."""
    none = F.array(F.lit(None).cast("string"))
    one = m.by_row().select(F.explode(F.concat(none, "has")).alias("item1")).groupBy("item1").agg(F.count("*").alias("n"))
    return _prevalence(m, settled(one.withColumn("item2", F.lit(None).cast("string"))))


def _joint(m: BinaryMatrix, found: DataFrame) -> DataFrame:
    """``ord1 < ord2, n11`` of the pairs among ``cells``."""
    name = m.features.select("feature", "ord")
    both = found.where("item2 is not null").join(F.broadcast(name.select(F.col("feature").alias("item1"), F.col("ord").alias("a"))), "item1").join(
        F.broadcast(name.select(F.col("feature").alias("item2"), F.col("ord").alias("b"))), "item2")
    return both.select(F.least("a", "b").alias("ord1"), F.greatest("a", "b").alias("ord2"), F.col("n").alias("n11"))


def joint_counts(m: BinaryMatrix) -> DataFrame:
    """``ord1 < ord2, n11`` of the pairs that occur together in a row."""
    return _joint(m, cells(m))


def contingency(m: BinaryMatrix, cross_roles: bool = False, every: bool = False) -> DataFrame:
    """Tables of all pairs with ord1 < ord2 (or of a phenotype or class with a gene).

    Pairs with a feature that is constant over the rows are left out unless ``every``.
    Rows: item1, item2, role1, role2, ord1, ord2, k1, k2, n, n00, n01, n10, n11.
    """
    found = settled(cells(m))  # sums, of at most all pairs of columns: the rows are read once
    p = _prevalence(m, found, "role")
    if not every:
        p = p.where("k > 0 and k < n")
    a = p.select(F.col("feature").alias("item1"), F.col("role").alias("role1"), F.col("ord").alias("ord1"), F.col("k").alias("k1"), "n")
    b = p.select(F.col("feature").alias("item2"), F.col("role").alias("role2"), F.col("ord").alias("ord2"), F.col("k").alias("k2"))
    rule = (F.col("role1") != "gene") & (F.col("role2") == "gene") if cross_roles else F.col("ord1") < F.col("ord2")
    # As many rows as the matrix has pairs of columns, however many rows it has.
    joint = _joint(m, found)
    if cross_roles:  # a gene may come before a phenotype
        joint = joint.union(joint.select(F.col("ord2"), F.col("ord1"), "n11"))
    full = a.join(b, rule).join(joint, ["ord1", "ord2"], "left")
    n11 = F.coalesce("n11", F.lit(0)).cast("long")
    return full.select("item1", "item2", "role1", "role2", "ord1", "ord2", "k1", "k2", "n", (F.col("n") - F.col("k1") - F.col("k2") + n11).alias("n00"),
                       (F.col("k2") - n11).alias("n01"), (F.col("k1") - n11).alias("n10"), n11.alias("n11"))


def _counts() -> list[Column]:
    return [F.col(c) for c in ("n00", "n01", "n10", "n11")]


def tested(tables: DataFrame) -> DataFrame:
    """Adds chi2, p, phi and test; tables without a test are dropped, before any correction."""
    # The struct is read as one generated row, so a filter on it doesn't repeat its expressions.
    out = tables.select("*", F.inline(F.array(stats.association(*_counts()))))
    return out.where("p is not null")


#: Corrections for many tests, by the names of the usual statistics packages.
METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed below 64, by its expansion above, exact to double precision."""
    x = m.cast("double")
    small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(m.cast("long"), F.lit(64))), F.lit(0.0), lambda s, i: s + 1 / i)
    return F.when(m <= 64, small).otherwise(F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def adjust(df: DataFrame, p: str = "p", method: str = "fdr_bh", ties: tuple[str, ...] = ("item1", "item2"), out: str = "adj_p", by: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values over the whole table, or each part of it that has equal ``by``, by one of ``METHODS``.

    ``alpha`` matters to the two-stage methods only: what a first pass rejects at it tells
    how many hypotheses may hold.  The whole table is ranked part by part where it is
    large (see ``ordering``); a part with equal ``by`` is one resample's tests, as many as
    pairs of columns.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method in ("fdr_tsbh", "fdr_tsbky"):
        return _two_stages(df, p, method, ties, out, by, alpha)
    names = df.columns
    here, several = list(by), False
    if by:
        many, base = F.count("*").over(Window.partitionBy(*by)), F.lit(0)
    else:
        df, several = ordering.in_parts(df, [F.col(c) for c in (p, *ties)])
        here, many, base = ["_part"], F.lit(df.count()), F.lit(0)
        if several:
            df, base = ordering.with_parts_before(df, F.lit(1), "_base"), F.coalesce("_base", F.lit(0))
    window = Window.partitionBy(*here)
    ranked = df.withColumn("_r", F.row_number().over(window.orderBy(F.col(p), *ties)) + base).withColumn("_m", many)
    m, left = F.col("_m"), F.col("_m") - F.col("_r") + 1
    of_many = lambda k: F.when(F.col(p) < 1, -F.expm1(k * F.log1p(-F.col(p)))).otherwise(1.0)
    raw = {"bonferroni": F.col(p) * m, "sidak": of_many(m), "holm": F.col(p) * left, "holm-sidak": of_many(left), "simes-hochberg": F.col(p) * left,
           "fdr_bh": F.col(p) * m / F.col("_r"), "fdr_by": F.col(p) * m / F.col("_r") * _harmonic(m)}[method]
    if method in ("bonferroni", "sidak"):
        return ranked.select(*names, F.least(F.lit(1.0), raw).alias(out))
    down = method in ("fdr_bh", "fdr_by", "simes-hochberg")
    how, either = (F.min, F.least) if down else (F.max, F.greatest)
    value = how(raw).over(window.orderBy(F.desc("_r") if down else F.col("_r")).rowsBetween(Window.unboundedPreceding, 0))
    if several:
        ranked = ordering.with_parts_before(settled(ranked), raw, "_rest", how, later=down)
        value = either(value, F.col("_rest"))
    return ranked.withColumn("_v", value).select(*names, F.least(F.lit(1.0), F.col("_v")).alias(out))


def _two_stages(df: DataFrame, p: str, method: str, ties: tuple[str, ...], out: str, by: tuple[str, ...], alpha: float) -> DataFrame:
    """Adjusted for the hypotheses that a first pass leaves: times their share, unless it rejects none or all."""
    factor = 1 + alpha if method == "fdr_tsbky" else 1.0
    first = adjust(df, p, "fdr_bh", ties, "_bh", by)
    first = first if by else settled(first)
    gone, every = F.sum((F.col("_bh") <= alpha / factor).cast("long")), F.count("*")
    if by:
        part = Window.partitionBy(*by)
        full = first.withColumn("_gone", gone.over(part)).withColumn("_m", every.over(part))
    else:
        full = first.crossJoin(F.broadcast(first.agg(gone.alias("_gone"), every.alias("_m"))))
    share = F.when((F.col("_gone") == 0) | (F.col("_gone") == F.col("_m")), 1.0).otherwise((F.col("_m") - F.col("_gone")) / F.col("_m"))
    return full.select(*df.columns, F.least(F.lit(1.0), F.col("_bh") * share * factor).alias(out))


def cooccurrence(m: BinaryMatrix, alpha: float = 0.05, method: str = "fdr_bh", cross_roles: bool = False, tests: DataFrame | None = None) -> DataFrame:
    """Significant pairs with full precision: item1, item2, role1, role2, phi, raw_p, adj_p.

    ``tests``: the matrix's tested tables, where they are at hand.
    """
    out = adjust(tested(contingency(m, cross_roles)) if tests is None else tests, method=method).where(F.col("adj_p") <= alpha)
    return out.select("item1", "item2", "role1", "role2", "ord1", "ord2", "phi", F.col("p").alias("raw_p"), "adj_p")


def report_view(pairs: DataFrame) -> DataFrame:
    """Three digits, as reports show them, sorted by adjusted p."""
    cols = [F.bround(c, 3).alias(c) for c in ("phi", "raw_p", "adj_p")]
    return pairs.orderBy("adj_p", "item1", "item2").select("item1", "item2", *cols)


def cooccurrence_matrix(m: BinaryMatrix) -> DataFrame:
    """All cells of X'X that aren't 0, the diagonal included: item1, item2, n."""
    known = m.features.select("feature")
    found = settled(cells(m)).where("item1 is not null").join(F.broadcast(known.withColumnRenamed("feature", "item1")), "item1", "left_semi")
    found = found.join(F.broadcast(known.withColumnRenamed("feature", "item2")), "item2", "left_semi").select("item1", "item2", "n").union(found.where("item2 is null").select("item1", F.col("item1"), "n"))
    # each pair both ways, from one pass
    ways = F.when(F.col("item1") == F.col("item2"), F.array(F.struct("item1", "item2"))).otherwise(F.array(F.struct("item1", "item2"), F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2"))))
    return found.select(F.inline(ways), "n")


def phi_matrix(m: BinaryMatrix) -> DataFrame:
    """All ordered pairs of different features: item1, item2, phi (0 where a feature is constant)."""
    half = contingency(m, every=True).select("item1", "item2", F.coalesce(stats.phi(*_counts()), F.lit(0.0)).alias("phi"))
    return half.union(half.select("item2", "item1", "phi"))


def pearson(m: BinaryMatrix) -> DataFrame:
    """Ordered pairs with their correlation, null where a feature is constant; for 0/1 columns it is phi."""
    half = contingency(m, every=True).select("item1", "item2", stats.phi(*_counts()).alias("r"))
    return half.union(half.select("item2", "item1", "r"))


def pearson_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of numeric columns in one pass of sums: item1, item2, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("item1"), F.lit(b).alias("item2"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def jaccard_distances(m: BinaryMatrix) -> DataFrame:
    """item1, item2 (ord1 < ord2) and the Jaccard distance of their rows."""
    return contingency(m, every=True).select("item1", "item2", stats.jaccard_distance(F.col("n11"), F.col("k1"), F.col("k2")).alias("distance"))


def pairwise_tests(m: BinaryMatrix, test: str = "chi_square") -> DataFrame:
    """item1, item2, statistic, p without correction; (0, 1) where a feature is constant."""
    t = contingency(m, every=True)
    if test == "chi_square":
        stat = stats.plain_chi2(*_counts())
        return t.select("item1", "item2", stat.alias("statistic"), stats.chi2_p(stat).alias("p"))
    if test == "fisher":
        ok = stats.phi(*_counts()).isNotNull()
        return t.select("item1", "item2", F.lit(0.0).alias("statistic"), F.when(ok, stats.fisher_p(*_counts())).otherwise(1.0).alias("p"))
    raise ValueError(f"unknown test: {test}")
