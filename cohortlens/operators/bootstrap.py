"""Bootstrap intervals from sufficient statistics.

A resample of n rows of a 0/1 column has Binomial(n, k / n) ones, so replicates need only
(n, k) of each feature: no row moves.  Statistics of several columns at once share row
weights: a row's number of draws in replicate b, Poisson(1) from (seed, b, row), which is
the distributed form of the same resample.  All draws are functions of what they are for
(see ``functions.draws``), so SQL can repeat them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import draws
from ..functions.stats import ln_factorial
from ..sources.matrix import BinaryMatrix, few_features
from ..sources.shared import settled
from . import ordering, pairs


def binomial_draws(n: int, k: int, u: np.ndarray) -> np.ndarray:
    """Binomial(n, k / n) numbers by the inverse of its distribution function, summed ten deviations around the mean."""
    if k <= 0 or k >= n:
        return np.full(len(u), max(0, min(k, n)), np.int64)
    p = k / n
    wide = 10 * math.sqrt(n * p * (1 - p)) + 20
    low, high = max(0, math.floor(n * p - wide)), min(n, math.ceil(n * p + wide))
    x = np.arange(low, high)
    steps = np.log((n - x) / (x + 1)) + math.log(p / (1 - p))
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    cdf = np.cumsum(np.exp(first + np.r_[0.0, np.cumsum(steps)]))
    return low + np.minimum(np.searchsorted(cdf, u), high - low)


def binomial_intervals(counts: DataFrame, n_iter: int = 5000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """feature, mean, lower, upper (fractions) of (feature, k, n): percentiles of seeded replicates.

    ``mean`` is the mean of the replicates.  A replicate depends on (seed, feature, its
    number) only, so the result doesn't depend on partitions.
    """

    def run(batches):
        replicate = np.arange(n_iter, dtype=np.int64)
        for pdf in batches:
            rows = []
            for f, k, n in zip(pdf["feature"], pdf["k"], pdf["n"]):
                x = binomial_draws(int(n), int(k), draws.unit(draws.name_key(f), replicate, seed)) / n if n else np.zeros(1)
                lo, hi = np.percentile(x, [50 * (1 - confidence), 50 * (1 + confidence)])
                rows.append((f, x.mean(), lo, hi))
            yield pd.DataFrame(rows, columns=["feature", "mean", "lower", "upper"])

    return counts.select("feature", "k", "n").mapInPandas(run, "feature string, mean double, lower double, upper double")


def bootstrap_ci(m: BinaryMatrix, n_iter: int = 5000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """The table of reports: percent with three digits, by falling mean."""
    ci = binomial_intervals(pairs.prevalence(m), n_iter, confidence, seed)
    pct = [F.bround(F.col(c) * 100, 3).alias(c) for c in ("mean", "lower", "upper")]
    return ci.select("feature", *pct).orderBy(F.desc("mean"), "feature")


def binomial_quantile(n: Column, k: Column, q: float) -> Column:
    """Smallest x whose Binomial(n, k / n) distribution function reaches q: exact, in the JVM.

    Sums the mass around the mean, ten deviations wide; the rest is below 1e-20.
    """
    p = k.cast("double") / n
    sd = F.sqrt(n * p * (1 - p))
    low = F.greatest(F.lit(0), F.floor(n * p - 10 * sd - 20)).cast("long")
    high = F.least(n, F.ceil(n * p + 10 * sd + 20)).cast("long")

    def mass(x: Column) -> Column:
        return F.exp(ln_factorial(n) - ln_factorial(x) - ln_factorial(n - x) + x * F.log(p) + (n - x) * F.log1p(-p))

    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("x"))

    def step(s: Column, x: Column) -> Column:
        cdf = s["cdf"] + mass(x)
        return F.struct(cdf.alias("cdf"), F.when((s["x"] < 0) & (cdf >= q - 1e-9), x).otherwise(s["x"]).alias("x"))

    found = F.aggregate(F.sequence(low, high), start, step, lambda s: s["x"])
    return F.when(k <= 0, F.lit(0).cast("long")).when(k >= n, n.cast("long")).otherwise(found)


def exact_intervals(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """feature, mean, lower, upper (fractions): what the replicates' percentiles tend to; no sampling."""
    n, k = F.col("n"), F.col("k")
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    return counts.where("n > 0").select("feature", (k / n).alias("mean"), (binomial_quantile(n, k, lo) / n).alias("lower"), (binomial_quantile(n, k, hi) / n).alias("upper"))


def pattern_intervals(frequencies: DataFrame, n_iter: int = 5000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """pattern, n, frequency, lower, upper in percent: a pattern's count in a resample is binomial."""
    total = frequencies.agg(F.sum("n").alias("total"))
    counts = frequencies.crossJoin(F.broadcast(total)).select(F.col("pattern").alias("feature"), F.col("n").alias("k"), F.col("total").alias("n"))
    ci = binomial_intervals(counts, n_iter, confidence, seed).select(F.col("feature").alias("pattern"), (F.col("lower") * 100).alias("lower"), (F.col("upper") * 100).alias("upper"))
    return frequencies.join(ci, "pattern")


STATISTICS = ("mean", "median", "std")
#: Cuts of a group's values for medians, sums that a task keeps before it hands them on.
CUTS, KEPT_KEYS = 256, 2048
#: Draws that are made at once (they stay in the cache), and of rows of a block in a sum at least the share that has a key for a product of matrices.
DRAWS_AT_ONCE, DENSE = 1 << 17, 1 / 32


def _at_once(replicates: int) -> int:
    return max(16, min(1024, DRAWS_AT_ONCE // max(1, replicates)))


def _moments(keyed: DataFrame, replicates: int, seed: int, squares: bool = True) -> DataFrame:
    """key, replicate, n, s1, s2: sums of the weights of ``row_weights``, and of them times value and its square, over the rows of each key.

    Without ``squares`` n alone, and no value is read.  A task keeps the sums of at most
    ``KEPT_KEYS`` keys and hands them on when there are more, so its memory doesn't grow
    with the keys; the rows of a key are spread over all tasks.
    """
    row = draws.row_key(F.col("row"), keyed.schema["row"].dataType)
    names = ["n", "s1", "s2"] if squares else ["n"]

    def run(batches):
        step, sums = _at_once(replicates), {}

        def hand_on() -> pa.RecordBatch:
            flat = [pa.array(np.concatenate([x[c] for x in sums.values()])) for c in range(len(names))]
            ends = pa.array(np.arange(len(sums) + 1) * replicates, pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *[pa.ListArray.from_arrays(ends, x) for x in flat]], ["key", *names])
            sums.clear()
            return out

        for batch in batches:
            key, r, *x = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns))
            order = np.argsort(key, kind="stable")
            for at in range(0, len(r), step):
                some = order[at : at + step]
                weight = draws.poisson(r[some], replicates, seed).astype(float)
                found, begin = np.unique(key[some], return_index=True)
                for name, a, b in zip(found.tolist(), begin, np.r_[begin[1:], len(some)]):
                    factor = np.ones((len(names), b - a))
                    if squares:
                        factor[1] = x[0][some[a:b]]
                        factor[2] = factor[1] ** 2
                    parts = factor @ weight[a:b]
                    if name in sums:
                        sums[name] += parts
                    else:
                        sums[name] = parts
                if len(sums) > KEPT_KEYS:
                    yield hand_on()
        if sums:
            yield hand_on()

    kind = ", ".join(f"{c} array<double>" for c in names)
    value = [F.col("value").cast("double")] if squares else []
    parts = keyed.select(F.col("key").cast("long"), row.alias("r"), *value).mapInArrow(run, f"key long, {kind}")
    each = parts.select("key", F.posexplode(F.arrays_zip(*names)).alias("replicate", "s")).select("key", "replicate", "s.*")
    return each.groupBy("key", "replicate").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in names[1:]])


def grouped_statistic(values: DataFrame, statistic: str = "mean", n_iter: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """name, estimate, lower, upper of a statistic of (name, row, value), for groups of any number and size.

    A replicate weighs each row by ``row_weights``; ``row`` tells all rows apart.  Null
    values are left out, and replicates that draw no row of a group.  Means and deviations
    (of the whole, not of a sample) come from sums.  A median comes from the weights summed
    in up to ``CUTS`` ranges of the group's values: they tell which range holds each
    replicate's middle, and only that range's values are then ordered.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic: {statistic}")
    known = values.select(F.col("name").cast("string").alias("name"), "row", F.col("value").cast("double").alias("value")).where("value is not null")
    names = settled(ordering.numbered(known.groupBy("name").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("std"), F.percentile_approx("value", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts")).where("name is not null"), ["name"], "number"))
    base = known.join(names.select("name", "number", "center", "cuts"), "name")
    if statistic == "median":
        estimate = ordering.quantiles(known, "value", {"estimate": 0.5}, ("name",))
        reps = _medians(base, n_iter, seed)
    else:
        estimate = names.select("name", F.col("center" if statistic == "mean" else "std").alias("estimate"))
        # values are taken from the group's mean, so that squares don't swamp the deviations
        sums = _moments(base.select(F.col("number").alias("key"), "row", (F.col("value") - F.col("center")).alias("value")), n_iter, seed).where("n > 0")
        mean = F.col("s1") / F.col("n")
        x = mean if statistic == "mean" else F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))
        reps = sums.select(F.col("key").alias("number"), x.alias("x"))
    limits = reps.groupBy("number").agg(F.percentile("x", F.lit((1 - confidence) / 2)).alias("lower"), F.percentile("x", F.lit((1 + confidence) / 2)).alias("upper"))
    shift = F.col("center") if statistic == "mean" else F.lit(0.0)
    out = names.select("name", "number", "center").join(limits, "number").select("name", (F.col("lower") + shift).alias("lower"), (F.col("upper") + shift).alias("upper"))
    return estimate.join(out, "name").select("name", "estimate", "lower", "upper")


def _medians(base: DataFrame, replicates: int, seed: int) -> DataFrame:
    """number, x: the weighted median of each group and replicate.

    Ranges are cut twice: the rows of a range that holds middles are cut again, so that
    what is drawn row by row in the end is a group's rows over the square of ``CUTS``.
    """
    # a value's range is the number of cuts below it, so equal values share one
    place = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    ranged = settled(base.select("number", "row", "value", place.cast("long").alias("range")))
    sums = _range_sums(ranged, replicates, seed)
    # a group and replicate have as many rows as ranges
    over = Window.partitionBy("number", "replicate")
    cum = sums.withColumn("before", F.sum("n").over(over.orderBy("range")) - F.col("n")).withColumn("all", F.sum("n").over(over)).where("all > 0")
    middles = F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))
    wanted = cum.select("number", "range", "replicate", "before", "n", F.posexplode(middles).alias("side", "at")).where("before <= at and at < before + n")
    wanted = settled(wanted.select("number", "range", "replicate", "side", (F.col("at") - F.col("before")).alias("at")))
    # the same inside the ranges that hold middles
    near = ranged.join(wanted.select("number", "range").distinct(), ["number", "range"])
    cuts = near.groupBy("number", "range").agg(F.percentile_approx("value", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts"))
    fine = near.join(cuts, ["number", "range"]).select("number", "row", "value", (F.col("range") * CUTS + place).alias("range"))
    fine = settled(fine.sortWithinPartitions("number", "range"))  # so that a task is done with a range before the next
    within = _range_sums(fine, replicates, seed).withColumnRenamed("range", "fine").withColumn("range", F.floor(F.col("fine") / CUTS))
    over = Window.partitionBy("number", "range", "replicate").orderBy("fine")
    held = within.withColumn("before", F.sum("n").over(over) - F.col("n")).join(wanted, ["number", "range", "replicate"]).where("before <= at and at < before + n")
    span = fine.groupBy("number", F.col("range").alias("fine")).agg(F.min("value").alias("least"), F.max("value").alias("largest"))
    held = settled(held.join(span, ["number", "fine"]).select("number", F.col("fine").alias("range"), "replicate", "side", (F.col("at") - F.col("before")).alias("at"), "least", "largest"))
    known = held.where("least = largest").select("number", "replicate", "side", F.col("least").alias("value"))
    wanted = held.where("least < largest").drop("least", "largest")
    key = draws.row_key(F.col("row"), base.schema["row"].dataType)
    drawn = fine.join(wanted.select("number", "range", "replicate").distinct(), ["number", "range"]).withColumn("w", draws.poisson_column(draws.unit(key, F.col("replicate"), seed))).where("w > 0")
    by = drawn.groupBy("number", "range", "replicate", "value").agg(F.sum("w").alias("w"))
    inside = Window.partitionBy("number", "range", "replicate").orderBy("value")
    reached = by.withColumn("upto", F.sum("w").over(inside)).join(wanted, ["number", "range", "replicate"]).where("upto > at")
    ends = reached.groupBy("number", "replicate", "side").agg(F.min("value").alias("value")).union(known)
    return ends.groupBy("number", "replicate").agg(F.avg("value").alias("x")).select("number", "x")


def _range_sums(ranged: DataFrame, replicates: int, seed: int) -> DataFrame:
    """number, range, replicate, n of (number, row, range), with ranges below the square of ``CUTS``."""
    wide = CUTS * CUTS
    sums = _moments(ranged.select((F.col("number") * wide + F.col("range")).alias("key"), "row"), replicates, seed, squares=False)
    return sums.select(F.floor(F.col("key") / wide).alias("number"), (F.col("key") % wide).alias("range"), "replicate", "n")


def row_weights(rows: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """row, replicate, weight: how often a row is drawn; rows that aren't drawn are left out."""
    spread = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    key = draws.row_key(F.col("row"), rows.schema["row"].dataType)
    return spread.withColumn("weight", draws.poisson_column(draws.unit(key, F.col("replicate"), seed))).where("weight > 0")


def resamples(m: BinaryMatrix, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, has, n: how often each distinct row of the matrix is drawn, for all replicates in one table.

    Rows with the same features are one, so the table grows with the patterns; whatever
    is computed by replicate runs once over it.  Rows are dealt by range of their pattern
    (and key, so that one pattern may fill several tasks): a pattern's sums are an array,
    made where its rows are, and only those at the ends of a task are added to others'.
    """
    rows = m.by_row()
    keyed = settled(rows.select(F.array_sort("has").alias("has"), draws.row_key(F.col("row"), rows.schema["row"].dataType).alias("r")))
    dealt = keyed.repartitionByRange("has", "r").sortWithinPartitions("has").select("has", F.to_json("has").alias("text"), "r")

    def run(batches):
        step = _at_once(replicates)
        # the pattern whose rows go on, its sums so far, and whether it is the task's first
        text, has, sums, first = None, None, None, True

        def made(rows: list) -> pa.RecordBatch:
            flat = pa.array(np.concatenate([x[1] for x in rows]).astype(np.int64))
            n = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * replicates, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.list_(pa.string())), n, pa.array([x[2] for x in rows], pa.bool_())], ["has", "n", "at_end"])

        for batch in batches:
            code = batch.column(1).dictionary_encode()
            names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            r, done = batch.column(2).to_numpy(), []
            for at in range(0, len(r), step):
                weight = draws.poisson(r[at : at + step], replicates, seed)
                here = code[at : at + step]
                begin = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                for a, b in zip(begin, np.r_[begin[1:], len(here)]):
                    got = weight[a:b].sum(0, dtype=np.int64)
                    if names[here[a]] == text:
                        sums += got
                        continue
                    if text is not None:
                        done.append((has, sums, first))
                        first = False
                    text, has, sums = names[here[a]], batch.column(0)[at + int(a)].as_py(), got
                if len(done) >= KEPT_KEYS:
                    yield made(done)
                    done = []
            if done:
                yield made(done)
        if text is not None:
            yield made([(has, sums, True)])

    parts = settled(dealt.mapInArrow(run, "has array<string>, n array<long>, at_end boolean"))
    each = lambda t: t.select(F.posexplode("n").alias("replicate", "n"), "has").select("replicate", "has", "n")
    ends = each(parts.where("at_end")).groupBy("replicate", "has").agg(F.sum("n").alias("n"))
    return each(parts.where("not at_end")).union(ends).where("n > 0")


def weight_sums(keyed: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """key, replicate, n: the weights of ``row_weights`` summed over the rows of each key, all replicates in one pass.

    ``keyed`` has ``row`` and ``keys``, an array of numbers without repeats; the number
    of keys is bounded by the columns, so a task keeps a sum for each key and replicate.
    A row's weights are one array in its task, and nothing but sums is exchanged.
    """
    row = draws.row_key(F.col("row"), keyed.schema["row"].dataType)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        step = _at_once(replicates)
        for batch in batches:
            keys, many = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy()
            r, ends = batch.column(1).to_numpy(), np.r_[0, np.cumsum(many)]
            for at in range(0, len(r), step):
                weight = draws.poisson(r[at : at + step], replicates, seed)
                owner = np.repeat(np.arange(len(weight)), many[at : at + step])
                names, place = np.unique(keys[ends[at] : ends[at] + len(owner)], return_inverse=True)
                if len(owner) >= DENSE * len(names) * len(weight):
                    # whole numbers below 2**24 are exact in single precision
                    has = np.zeros((len(names), len(weight)), np.float32)
                    has[place, owner] = 1
                    found = (has @ weight.astype(np.float32)).astype(np.int64)
                else:
                    order = np.argsort(place, kind="stable")
                    begin = np.searchsorted(place[order], np.arange(1, len(names)))
                    found = [weight[rows].sum(0, dtype=np.int64) for rows in np.split(owner[order], begin)]
                for name, got in zip(names.tolist(), found):
                    if name in sums:
                        sums[name] += got
                    else:
                        sums[name] = np.array(got)
        if sums:
            flat = pa.array(np.concatenate(list(sums.values())).astype(np.int64))
            n = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * replicates, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), n], ["key", "n"])

    parts = keyed.where(F.size("keys") > 0).select(F.col("keys").cast("array<long>"), row.alias("r")).mapInArrow(run, "key long, n array<long>")
    return parts.select("key", F.posexplode("n").alias("replicate", "n")).groupBy("key", "replicate").agg(F.sum("n").alias("n"))


#: The key of all rows in ``weight_sums``.
ALL = -1


def joint_intervals(m: BinaryMatrix, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """feature, mean, lower, upper with the same resample for all features, which keeps their dependence."""
    n = feature_sums(m, replicates, seed)
    total = n.where(F.col("key") == ALL).select("replicate", F.col("n").alias("total"))
    names = m.features.select("feature", F.col("ord").cast("long").alias("key"))
    hits = n.join(F.broadcast(names), "key").select("feature", "replicate", F.col("n").alias("hits"))
    grid = m.features.select("feature").crossJoin(F.broadcast(total.where("total > 0")))
    share = grid.join(hits, ["feature", "replicate"], "left").select("feature", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("x"))
    return share.groupBy("feature").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit((1 - confidence) / 2)).alias("lower"), F.percentile("x", F.lit((1 + confidence) / 2)).alias("upper"))


def feature_sums(m: BinaryMatrix, replicates: int, seed: int = 42) -> DataFrame:
    """``weight_sums`` by the features' ord and over all rows, settled: whatever reads them, the rows' draws are made once."""
    return settled(weight_sums(_feature_keys(m), replicates, seed))


def _feature_keys(m: BinaryMatrix) -> DataFrame:
    """row, keys: ``ALL`` and the ord of each feature of a row.  Where a row's array is known its features are looked up in it, without an exchange."""
    if m.arrays is not None and few_features(m.features):
        named = m.features.agg(F.map_from_entries(F.collect_list(F.struct("feature", "ord"))).alias("_of"))
        found = F.transform("has", lambda f: F.try_element_at("_of", f))
        has = m.arrays.crossJoin(F.broadcast(named)).select("row", F.array_distinct(F.array_compact(found)).alias("has"))
    else:
        has = m.ones.join(F.broadcast(m.features.select("feature", "ord")), "feature").groupBy("row").agg(F.collect_set("ord").alias("has"))
        has = m.rows.join(has, "row", "left")
    return has.select("row", F.concat(F.array(F.lit(ALL)), F.coalesce(F.col("has").cast("array<int>"), F.array().cast("array<int>"))).alias("keys"))
