"""Connected components by alternating large-star and small-star steps.

All steps are joins and grouped minima, so no node's links meet in one task and
nothing is collected; the number of rounds grows with the logarithm of the
longest path.  See Kiveris et al., "Connected Components in MapReduce and Beyond".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = near.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of the component.

    Null ends are ignored; no links give no rows.
    """
    now = scratch.table(edges.where("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    sign, first = None, now
    while True:
        after = scratch.table(_star(_star(now, True), False), "star")
        print_ = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now is not first:
            scratch.drop(now)
        now = after
        if tuple(print_) == sign:
            break
        sign = tuple(print_)
    scratch.drop(first)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
