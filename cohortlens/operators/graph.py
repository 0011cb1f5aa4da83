"""Co-occurrence networks: edges, centralities, shortest paths, row risk (communities: see ``communities``).

A network has at most as many nodes as the matrix has columns.  What iterates (paths,
eigenvectors) does so by joins on the node tables, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats
from ..sources.matrix import BinaryMatrix, few_features
from ..sources.shared import settled
from . import pairs
from .ordering import average_rank, placed, quantile_of_placed

def network_edges(m: BinaryMatrix, alpha: float = 0.05, method: str = "fdr_bh", tests: DataFrame | None = None) -> DataFrame:
    """Significant pairs of all features, tested together: src, dst, phi, p_value, edge_type."""
    e = pairs.cooccurrence(m, alpha, method, tests=tests)
    gene = lambda c: F.col(c) == "gene"
    kind = F.when(gene("role1") & gene("role2"), "gene-gene").when(gene("role1") | gene("role2"), "pheno-gene").otherwise("pheno-pheno")
    return e.select(F.col("item1").alias("src"), F.col("item2").alias("dst"), F.bround("phi", 3).alias("phi"), F.bround("adj_p", 3).alias("p_value"), kind.alias("edge_type"))


def edge_list(edges: DataFrame) -> DataFrame:
    """Edges with starred p-values, by p."""
    from ..functions.stats import stars

    return edges.withColumn("significance", stars(F.col("p_value"))).orderBy("p_value", "src", "dst")


def nodes(edges: DataFrame, m: BinaryMatrix | None = None) -> DataFrame:
    """Nodes with an edge: id, and node_type where the matrix is given."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    if m is None:
        return ids
    kind = F.when(F.col("role") == "gene", "Genotype").otherwise("Phenotype")
    return ids.join(F.broadcast(m.features.select(F.col("feature").alias("id"), kind.alias("node_type"))), "id")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, degree, degree_centrality = degree / (nodes - 1)."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """src, dst, distance, paths of all ordered pairs of connected nodes: breadth first from all nodes at once.

    A level joins the frontier with the edges, so the number of joins is the diameter.
    """
    step = settled(both_ways(edges))
    front = step.select("src", "dst", F.lit(1).alias("distance"), F.lit(1).cast("long").alias("paths"))
    seen, level = step.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("distance"), F.lit(1).cast("long").alias("paths")).union(front), 1
    on = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        level += 1
        new = front.join(on, "dst").groupBy("src", F.col("next").alias("dst")).agg(F.sum("paths").alias("paths"))
        front = settled(new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(level).alias("distance"), "paths"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)  # one table for each level: nothing is written twice


def betweenness(paths: DataFrame) -> DataFrame:
    """id, betweenness: the share of shortest paths through a node, over pairs without it, normalised.

    A source's dependencies are added up from its farthest level inwards, along the edges
    that its shortest paths use: a join with the edges for each level, of one row for each
    pair of nodes at that distance.
    """
    step = settled(paths.where("distance = 1").select(F.col("src").alias("v"), F.col("dst").alias("w")))
    top = paths.agg(F.max("distance")).first()[0] or 0
    level = lambda d, node, count: paths.where(F.col("distance") == d).select(F.col("src").alias("s"), F.col("dst").alias(node), F.col("paths").alias(count))
    below, found = None, []
    for d in range(top - 1, 0, -1):
        far = level(d + 1, "w", "pw")
        if below is not None:
            far = far.join(below.select("s", F.col("v").alias("w"), F.col("b").alias("bw")), ["s", "w"], "left")
        through = (1 + F.coalesce(F.col("bw"), F.lit(0.0)) if below is not None else F.lit(1.0)) / F.col("pw")
        near = far.select("s", "w", through.alias("share")).join(step, "w").join(level(d, "v", "pv"), ["s", "v"])
        below = settled(near.groupBy("s", "v").agg(F.sum(F.col("pv") * F.col("share")).alias("b")))
        found.append(below)
    ids = paths.where("src = dst").select(F.col("src").alias("id"))
    n = ids.agg(F.count("*").alias("n"))
    norm = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    if not found:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    score = every.groupBy(F.col("v").alias("id")).agg(F.sum("b").alias("b"))
    return ids.join(score, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("b", F.lit(0.0)) * norm).alias("betweenness"))


#: Edges, in both directions, that power iteration takes as arrays of one row; more are joined with the vector in each step.
FEW_EDGES = 1 << 15
#: Products of a job where there are more.
STEPS = 8


def eigenvector_centrality(edges: DataFrame, iterations: int = 1000, tolerance: float = 1e-10, few: int = FEW_EDGES) -> DataFrame:
    """id, eigenvector by power iteration of A + I from equal weights; length 1.

    It ends when a step changes less than ``tolerance`` a node, or after ``iterations``.
    Larger networks take the product of edges and vector as a join and a grouped sum.
    """
    step = settled(both_ways(edges))
    loops = step.select("src", F.col("src").alias("dst")).distinct()
    return (_eigen_arrays if step.limit(few + 1).count() <= few else _eigen_joins)(step.union(loops), iterations, tolerance)


def _eigen_arrays(step: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    ids = step.select(F.col("src").alias("id")).distinct()
    place = ids.withColumn("at", F.row_number().over(Window.orderBy("id")))
    near = step.join(F.broadcast(place.withColumnRenamed("id", "dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("at")).alias("near"))
    one = near.agg(F.array_sort(F.collect_list(F.struct("id", "near"))).alias("rows")).select(F.col("rows.id").alias("ids"), F.col("rows.near").alias("near"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda t, v: t + v)

    def product(x: Column) -> Column:
        return F.transform("near", lambda row: F.aggregate(row, F.lit(0.0), lambda t, at: t + F.element_at(x, at)))

    def unit(y: Column) -> Column:
        return stats.bind(F.sqrt(total(F.transform(y, lambda v: v * v))), lambda size: F.transform(y, lambda v: v / size))

    def more(s: Column, _: Column) -> Column:
        moved = lambda x: total(F.zip_with(x, s["x"], lambda a, b: F.abs(a - b)))
        following = stats.bind(stats.bind(product(s["x"]), unit), lambda x: F.struct(x.alias("x"), (moved(x) < F.size(x) * tolerance).alias("done")))
        return F.when(s["done"], s).otherwise(following)

    equal = F.transform("ids", lambda _: 1 / F.sqrt(F.size("ids").cast("double")))
    solved = one.where(F.size("ids") > 0).select("ids", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.struct(equal.alias("x"), F.lit(False).alias("done")), more, lambda s: s["x"]).alias("x"))
    return solved.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("x").alias("eigenvector"))))


def _eigen_joins(step: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    step = settled(step)
    x = step.groupBy(F.col("src").alias("id")).agg(F.lit(1.0).alias("v"))
    n = x.count()
    for _ in range(0, iterations, STEPS):
        for k in range(STEPS):
            # a node's own value comes along with its loop
            old = [F.max(F.when(F.col("src") == F.col("dst"), F.col("v"))).alias("old")] if k == STEPS - 1 else []
            x = step.join(x.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("v").alias("v"), *old)
        x = settled(x)
        size, before = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.sqrt(F.sum(F.col("old") * F.col("old")))).first()
        x = x.select("id", (F.col("v") / size).alias("v"), (F.col("old") / before).alias("old"))
        if x.agg(F.sum(F.abs(F.col("v") - F.col("old")))).first()[0] < n * tolerance:
            break
    return x.select("id", F.col("v").alias("eigenvector"))


def network_summary(edges: DataFrame, m: BinaryMatrix) -> DataFrame:
    """One row: nodes, edges, nodes of each type, average degree, density."""
    v = nodes(edges, m).agg(F.count("*").alias("n_nodes"), F.sum((F.col("node_type") == "Phenotype").cast("long")).alias("n_pheno"), F.sum((F.col("node_type") == "Genotype").cast("long")).alias("n_gene"))
    e = edges.agg(F.count("*").alias("n_edges"))
    n = F.col("n_nodes")
    return v.crossJoin(e).select("n_nodes", "n_edges", F.coalesce("n_pheno", F.lit(0)).alias("n_pheno"), F.coalesce("n_gene", F.lit(0)).alias("n_gene"),
                                 F.when(n > 0, 2 * F.col("n_edges") / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0).alias("density"))


def node_scores(edges: DataFrame) -> DataFrame:
    """id, degree_centrality, betweenness, eigenvector, node_score = .4, .3 and .3 of them."""
    paths = shortest_paths(edges)
    full = degree_centrality(edges).join(betweenness(paths), "id").join(eigenvector_centrality(edges), "id")
    return full.withColumn("node_score", 0.4 * F.col("degree_centrality") + 0.3 * F.col("betweenness") + 0.3 * F.col("eigenvector"))


def ci_weights(intervals: DataFrame) -> DataFrame:
    """feature, weight from (feature, lo, hi) as fractions: 1 / (width + .01), or 1 for no width, over the largest."""
    w = intervals.select("feature", F.when(F.col("hi") - F.col("lo") > 0, 1 / (F.col("hi") - F.col("lo") + 0.01)).otherwise(1.0).alias("w"))
    top = w.agg(F.max("w").alias("top"))
    return w.crossJoin(F.broadcast(top)).select("feature", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(F.col("w")).alias("weight"))


def row_risk(m: BinaryMatrix, scores: DataFrame, intervals: DataFrame | None = None, percentile: float = 75.0) -> DataFrame:
    """row, risk, percentile_rank, predicted: sum over a row's nodes of score times confidence weight.

    Features without an interval weigh 1; predicted is a risk above the percentile.
    """
    s = scores.select(F.col("id").alias("feature"), "node_score")
    if intervals is not None:
        s = s.join(ci_weights(intervals), "feature", "left").select("feature", (F.col("node_score") * F.coalesce("weight", F.lit(1.0))).alias("node_score"))
    # rounding makes equal sums equal, in whatever order they were added
    rounded = lambda risk: F.round(F.coalesce(risk, F.lit(0.0)), 12).alias("risk")
    if m.arrays is not None and few_features(m.features):
        # a row's scores are looked up in its array: no exchange
        known = s.where("node_score is not null").agg(F.map_from_entries(F.collect_list(F.struct("feature", "node_score"))).alias("_scores"))
        total = F.aggregate("has", F.lit(0.0), lambda t, f: t + F.coalesce(F.try_element_at("_scores", f), F.lit(0.0)))
        full = m.arrays.crossJoin(F.broadcast(known)).select("row", rounded(total))
    else:
        risk = m.ones.join(F.broadcast(s), "feature").groupBy("row").agg(F.sum("node_score").alias("risk"))
        full = m.rows.join(risk, "row", "left").select("row", rounded(F.col("risk")))
    full = settled(placed(full, "risk"))
    limit = quantile_of_placed(full, "risk", percentile / 100, "_limit")
    return full.crossJoin(F.broadcast(limit)).select("row", "risk", average_rank().alias("percentile_rank"), (F.col("risk") > F.col("_limit")).alias("predicted"))
