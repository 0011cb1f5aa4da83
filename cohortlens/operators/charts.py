"""The bounded frames behind charts; drawing them is left to whatever library is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import graph
from .ordering import quantiles


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1), lo, hi, n of equal-width bins between the column's extremes; empty bins are left out.

    One pass for the extremes and one grouped count; nulls are left out.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / width) + 1, F.lit(bins))).otherwise(1)
    by = x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return by.select("bin", (F.col("a") + (F.col("bin") - 1) * width).alias("lo"), (F.col("a") + F.col("bin") * width).alias("hi"), "n")


def extremes(df: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    """The k largest and the k smallest rows: name, value, side."""
    rows = df.select(name, value)
    top = rows.orderBy(F.desc(value), name).limit(k).withColumn("side", F.lit("top"))
    return top.union(rows.orderBy(value, name).limit(k).withColumn("side", F.lit("bottom")))


def spread_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Five numbers of a box for each group: least, quartiles, largest."""
    return quantiles(df, value, {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "largest": 1.0}, (group,))


def network_nodes(edges: DataFrame) -> DataFrame:
    """id, degree, size of the drawn node."""
    return graph.degree_centrality(edges).select("id", "degree", (15 + 3 * F.col("degree")).alias("size"))


def top_sequences(found: DataFrame, k: int = 15) -> DataFrame:
    """The patterns drawn as bars, by falling confidence."""
    return found.orderBy(F.desc("confidence"), F.desc("support"), "pattern").limit(k)
