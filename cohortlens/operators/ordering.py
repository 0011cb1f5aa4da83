"""Ranks, running sums and quantiles over a whole table, without a window that holds it.

Rows are dealt by range of their order and sorted inside each part; one number for each
part (its total) tells what comes before it.  A table of at most ``ONE_TASK`` rows is
counted first and handled by one window: the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import settled

#: Rows that a window over everything takes as one task (some 100 MB).
ONE_TASK = 1 << 18


def _names(*order: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in order]


def in_parts(df: DataFrame, order: list[Column]) -> tuple[DataFrame, bool]:
    """(settled rows with ``_part``, are there several): parts are ranges of the order, numbered along it; a small table is one."""
    rows = settled(df)
    if rows.count() <= ONE_TASK:
        return rows.withColumn("_part", F.lit(0)), False
    return settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())), True


def with_parts_before(rows: DataFrame, value: Column, out: str, how=F.sum, later: bool = False) -> DataFrame:
    """The rows with ``how`` of the value over all parts before (or, with ``later``, after) their own; null where there are none."""
    by = rows.groupBy("_part").agg(how(value).alias("_v"))
    # one row for each part: as many as partitions
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_part") if later else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(by.select("_part", how("_v").over(w).alias(out))), "_part")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """The rows with their place (from 1) along the order, which has to tell all rows apart."""
    rows, several = in_parts(df, _names(*order))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*_names(*order)))
    if several:
        rows = with_parts_before(rows, F.lit(1), "_base")
        return rows.withColumn(out, inside + F.coalesce("_base", F.lit(0))).drop("_part", "_base")
    return rows.withColumn(out, inside).drop("_part")


def ordered_counts(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by, value) with ``_c`` rows, ``_below`` rows of the group with smaller values and ``_n`` rows of the group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    rows, several = in_parts(counts, _names(*by, value))
    inside = lambda *part: F.coalesce(F.sum("_c").over(Window.partitionBy(*part).orderBy(*_names(*by, value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if several:
        run = with_parts_before(rows, F.col("_c"), "_base").withColumn("_under", F.coalesce("_base", F.lit(0)) + inside("_part"))
    else:
        run = rows.withColumn("_under", inside("_part"))
    if not by:
        total = rows.agg(F.sum("_c").alias("_n"))
        return run.crossJoin(F.broadcast(total)).select(value, "_c", F.col("_under").alias("_below"), "_n")
    run = settled(run)
    groups = run.groupBy(*by).agg(F.min("_under").alias("_first"), F.sum("_c").alias("_n"))
    return run.join(groups, list(by)).select(*by, value, "_c", (F.col("_under") - F.col("_first")).alias("_below"), "_n")


def placed(df: DataFrame, value: str) -> DataFrame:
    """The rows with ``_below`` (rows with smaller values; null is the smallest), ``_c`` (rows with the same) and ``_n`` (all rows).

    No row is joined by its value, which many may share: rows are dealt by range of the
    value and a hash of the row, so that a value's rows may fill several parts.  Inside a
    part they are counted by windows; a value that goes on in other parts is a part's
    first or last, and the counts of these, two for each part, are told to their parts.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    rows, several = in_parts(df, [*_names(value), spread])
    v = F.col(f"`{value}`")
    inside = rows.select("*", (F.rank().over(Window.partitionBy("_part").orderBy(v)) - 1).cast("long").alias("_below"), F.count(F.lit(1)).over(Window.partitionBy("_part", v)).alias("_c"))
    if not several:
        return inside.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_part"))).drop("_part")
    by_part = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct(v.isNotNull(), v.alias("v"))).alias("_first"), F.max(F.struct(v.isNotNull(), v.alias("v"))).alias("_last"))
    ends = settled(by_part)  # one row for each part: as many as partitions
    edge = rows.join(F.broadcast(ends), "_part").where(v.eqNullSafe(F.col("_first.v")) | v.eqNullSafe(F.col("_last.v"))).groupBy("_part", v.alias("_v")).agg(F.count(F.lit(1)).alias("_here"))
    along = Window.partitionBy("_v").orderBy("_part")
    edge = edge.select("_part", "_v", (F.sum("_here").over(along) - F.col("_here")).alias("_earlier"), (F.sum("_here").over(Window.partitionBy("_v")) - F.col("_here")).alias("_elsewhere"))
    before = ends.select("_part", F.coalesce(F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_n"))
    edges = edge.withColumnRenamed("_part", "_edge_part")
    full = inside.join(F.broadcast(before), "_part").join(F.broadcast(edges), (F.col("_part") == F.col("_edge_part")) & v.eqNullSafe(F.col("_v")), "left")
    return full.withColumn("_below", F.col("_base") + F.col("_below") - F.coalesce("_earlier", F.lit(0))).withColumn("_c", F.col("_c") + F.coalesce("_elsewhere", F.lit(0))).drop(
        "_part", "_base", "_edge_part", "_v", "_earlier", "_elsewhere")


def average_rank() -> Column:
    """Of ``placed`` rows: the average-tie rank in percent."""
    return (F.col("_below") + (F.col("_c") + 1) / 2) / F.col("_n") * 100


def percentile_rank(df: DataFrame, value: str, out: str = "percentile_rank") -> DataFrame:
    """The rows with their average-tie rank in percent."""
    return placed(df, value).withColumn(out, average_rank()).drop("_below", "_c", "_n")


def _quantile(value: str, q: float) -> Column:
    """An aggregate over distinct values, or rows, with their ``_below``, ``_c`` and ``_n``."""
    place = (F.col("_n") - 1) * q
    at = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col(f"`{value}`").cast("double")))
    low, high = at(F.floor(place)), at(F.ceil(place))
    share = F.max(place - F.floor(place))
    # the form of a weighted sum, as the usual percentile functions have it
    return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group a row with the named quantiles, interpolated between neighbours; nulls are left out."""
    known = ordered_counts(df.where(F.col(value).isNotNull()), value, by)
    return known.groupBy(*by).agg(*[_quantile(value, q).alias(name) for name, q in shares.items()])


def quantile_of_placed(rows: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """One row: the interpolated quantile of ``placed`` rows without null values."""
    return rows.agg(_quantile(value, q).alias(out))
