"""Communities of a network of any size: modularity, Louvain's method and components, as joins and sums.

Nothing is handled as one group.  A round of moves joins the edges with the nodes' labels
and sums by node and community; contraction is a grouped sum.  Hubs are keys of these
joins; Spark splits skewed ones (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import settled
from . import ordering

#: Rounds of a level at most (what is left to gain then is left to the next level), and what counts as a gain.
ROUNDS, LEAST_GAIN = 60, 1e-12


def weighted(edges: DataFrame, weight: str | None = "phi") -> DataFrame:
    """src, dst, w in both directions; repeated edges add up, null weights and loops are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    one = edges.select("src", "dst", w.alias("w")).where("src <> dst and w is not null")
    return one.union(one.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _modularity(both: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of (id, community) over edges in both directions (loops once); null for a total weight of 0."""
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    by = both.join(a, "src").join(b, "dst").groupBy("_a").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w"))).alias("inside"))
    total = both.agg(F.sum("w").alias("total"))
    share = F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.pow(F.col("all") / F.col("total"), 2)
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.when(F.col("total") != 0, share)).alias("modularity"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = "phi") -> DataFrame:
    """One row ``modularity`` of (id, community); nodes without a community take no part."""
    return _modularity(weighted(edges, weight), communities)


def _strengths(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))


def _moves(both: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """id, old, new: moves that gain, at most one out of or into a community.

    Each node's best move is a wish (ties: the smaller name); it is granted if no wish that
    touches one of its two communities gains more.  Granted moves touch different
    communities, so their gains add up exactly and modularity always grows.
    """
    mass = labels.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("mass"))
    ends = labels.select(F.col("id").alias("dst"), F.col("community").alias("c"))
    links = both.where("src <> dst").join(ends, "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("links"))
    # each node's own community is a choice too, with no links if it is alone there
    every = links.union(labels.select("id", F.col("community"), F.lit(0.0))).groupBy("id", "c").agg(F.sum("links").alias("links"))
    own = F.col("c") == F.col("community")
    gain = F.col("links") - F.col("k") * (F.col("mass") - F.when(own, F.col("k")).otherwise(0.0)) / total
    full = every.join(labels, "id").join(mass, "c").withColumn("gain", gain)
    best = F.min(F.when(~own, F.struct((-F.col("gain")).alias("g"), "c")))
    wish = full.groupBy("id").agg(best.alias("best"), F.max(F.when(own, F.col("gain"))).alias("stay"), F.first("community").alias("old"))
    wish = wish.select("id", "old", F.col("best.c").alias("new"), F.round(-F.col("best.g") - F.col("stay"), 12).alias("gain")).where(F.col("gain") > LEAST_GAIN)
    rank = F.struct((-F.col("gain")).alias("g"), "id")
    wish = settled(wish.withColumn("rank", rank))
    first = wish.select(F.explode(F.array("old", "new")).alias("c"), "rank").groupBy("c").agg(F.min("rank").alias("first"))
    granted = wish
    for end in ("old", "new"):
        granted = granted.join(first.select(F.col("c").alias(end), F.col("first").alias(f"_{end}")), end)
    return granted.where("rank = _old and rank = _new").select("id", "new")


def _level(both: DataFrame, total: float) -> DataFrame:
    """Labels after moves until none gains (or ``ROUNDS``): id, community."""
    labels = settled(_strengths(both).select("id", F.col("id").alias("community"), "k"))
    for _ in range(ROUNDS):
        moves = _moves(both, labels, total)
        after = settled(labels.join(moves, "id", "left").select("id", F.coalesce("new", "community").alias("community"), "k", F.col("new").isNotNull().alias("moved")))
        if not after.where("moved").limit(1).count():
            break
        labels = after.drop("moved")
    return labels.select("id", "community")


def louvain(edges: DataFrame, weight: str | None = "phi") -> DataFrame:
    """id, community (from 1) by local moves and contraction, until modularity no longer grows.

    Weights may be negative; where their sum isn't positive every node stays alone.
    Communities are numbered by falling size, then by their first node.  The result
    depends on the edges only.
    """
    both = settled(weighted(edges, weight))
    members = _strengths(both).select("id", F.col("id").alias("community"))
    best = None
    for _ in range(ROUNDS):
        total = both.agg(F.sum("w")).first()[0] or 0.0
        if total <= 0:
            break
        # loops hold what lies inside a contracted community, so singletons' modularity is that of the level before
        before = best if best is not None else _modularity(both, both.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()).first()[0]
        labels = _level(both, total)
        best = _modularity(both, labels).first()[0]
        if best <= before + LEAST_GAIN:
            break
        members = settled(members.select("id", F.col("community").alias("_c")).join(labels.select(F.col("id").alias("_c"), "community"), "_c").select("id", "community"))
        a, b = (labels.select(F.col("id").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst"))
        both = settled(both.join(a, "src").join(b, "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")))
    return numbered(members)


def numbered(members: DataFrame) -> DataFrame:
    """id, community with communities numbered from 1 by falling size, then by their first node."""
    groups = members.groupBy("community").agg((-F.count("*")).alias("_size"), F.min("id").alias("_first"))
    places = ordering.numbered(groups, ["_size", "_first"], "_n")
    return members.join(places.select("community", "_n"), "community").select("id", F.col("_n").cast("int").alias("community"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest name that the edges reach.

    A round gives each node the least label around it and then that label's own label, so
    labels travel ever farther; it needs the edges only, not the paths between all pairs.
    """
    one = edges.select("src", "dst").where("src <> dst")
    both = settled(one.union(one.select("dst", "src")).distinct())
    labels = settled(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("component")))
    while True:
        of = labels.select(F.col("id").alias("dst"), "component")
        around = both.join(of, "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        near = labels.join(around, "id").select("id", F.least("component", "near").alias("near"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        labels = settled(near.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("component"), "old"))
        if not labels.where("component <> old").limit(1).count():
            return labels.select("id", "component")
        labels = labels.drop("old")
