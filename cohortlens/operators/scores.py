"""Composite scores: co-selection of genes, modules, rankings, intervention targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import graph


def strongest_first(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair of names, the one with the strongest phi: lo, hi, phi."""
    named = pairs.select(F.least("item1", "item2").alias("lo"), F.greatest("item1", "item2").alias("hi"), "phi")
    return named.groupBy("lo", "hi").agg(F.max_by("phi", F.abs("phi")).alias("phi"))


def coselection_scores(wanted: DataFrame, pairs: DataFrame, paths: DataFrame, communities: DataFrame) -> DataFrame:
    """Adds ``cs`` to (gene1, gene2): min(1, .4 min(|phi|, 1) + .3 / (d + 1) + .3 same community).

    No association counts 0, no path counts 0; two genes without a community are in the same one.
    """
    p = strongest_first(pairs)
    d = paths.select(F.col("src").alias("gene1"), F.col("dst").alias("gene2"), "distance")
    c = communities.select("id", "community")
    full = wanted.withColumn("lo", F.least("gene1", "gene2")).withColumn("hi", F.greatest("gene1", "gene2")).join(p, ["lo", "hi"], "left").drop("lo", "hi")
    full = full.join(d, ["gene1", "gene2"], "left")
    full = full.join(F.broadcast(c.select(F.col("id").alias("gene1"), F.col("community").alias("c1"))), "gene1", "left").join(
        F.broadcast(c.select(F.col("id").alias("gene2"), F.col("community").alias("c2"))), "gene2", "left")
    strength = F.least(F.abs(F.coalesce("phi", F.lit(0.0))), F.lit(1.0))
    near = F.coalesce(1 / (F.col("distance") + 1), F.lit(0.0))
    same = F.col("c1").eqNullSafe(F.col("c2")).cast("double")
    return full.select(*wanted.columns, F.least(F.lit(1.0), 0.4 * strength + 0.3 * near + 0.3 * same).alias("cs"))


def community_pairs(communities: DataFrame) -> DataFrame:
    """gene1 < gene2 of the same community."""
    a = communities.select(F.col("id").alias("gene1"), "community")
    b = communities.select(F.col("id").alias("gene2"), "community")
    return a.join(b, "community").where("gene1 < gene2").select("gene1", "gene2", "community")


def coselection_modules(pairs: DataFrame, paths: DataFrame, communities: DataFrame, threshold: float = 0.7, min_size: int = 2) -> DataFrame:
    """Communities with enough strong pairs: module_id, genes, n_genes, avg_cs_score, n_high_scoring_pairs, predicted_mge."""
    scored = coselection_scores(community_pairs(communities), pairs, paths, communities).where(F.col("cs") >= threshold)
    high = scored.groupBy("community").agg(F.count("*").alias("n_high_scoring_pairs"), F.avg("cs").alias("avg_cs_score")).where(F.col("n_high_scoring_pairs") >= max(1, min_size - 1))
    members = communities.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("genes"))
    return high.join(members, "community").select(F.col("community").alias("module_id"), "genes", F.size("genes").alias("n_genes"), "avg_cs_score", "n_high_scoring_pairs", F.lit(True).alias("predicted_mge"))


def coselection_network(pairs: DataFrame, paths: DataFrame, communities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct unordered associated pairs with a score of the threshold or more: gene1, gene2, weight."""
    wanted = strongest_first(pairs).select(F.col("lo").alias("gene1"), F.col("hi").alias("gene2"))
    return coselection_scores(wanted, pairs, paths, communities).where(F.col("cs") >= threshold).withColumnRenamed("cs", "weight")


def rank_by_potential(pairs: DataFrame, paths: DataFrame, communities: DataFrame, top_n: int = 20) -> DataFrame:
    """rank, gene, potential = .4 share of strong partners + .4 mean score + .2 min(community / 10, 1)."""
    ids = paths.select(F.col("src").alias("id")).distinct()
    u, v = ids.select(F.col("id").alias("gene1")), ids.select(F.col("id").alias("gene2"))
    scored = coselection_scores(u.join(v, F.col("gene1") != F.col("gene2")), pairs, paths, communities)
    size = communities.groupBy("community").agg(F.count("*").alias("size"))
    of = communities.join(size, "community").select(F.col("id").alias("gene1"), "size")
    by = scored.groupBy("gene1").agg(F.sum((F.col("cs") >= 0.7).cast("long")).alias("strong"), F.count("*").alias("others"), F.avg("cs").alias("mean_cs"))
    full = by.join(of, "gene1", "left")
    potential = 0.4 * F.col("strong") / F.greatest(F.col("others"), F.lit(1)) + 0.4 * F.col("mean_cs") + 0.2 * F.least(F.coalesce("size", F.lit(0)) / 10, F.lit(1.0))
    out = full.select(F.col("gene1").alias("gene"), F.round(potential, 12).alias("potential"), "strong", "mean_cs")
    return ranked(out, F.desc("potential"), "gene").where(F.col("rank") <= top_n)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """``rank`` from 1 in an order without ties; for tables of nodes."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


# Weights of the parts of the priority.
TARGET_WEIGHTS = {"association": 0.3, "degree": 0.2, "betweenness": 0.2, "prevalence": 0.2, "mobility": 0.1}


def named_associations(df: DataFrame) -> DataFrame:
    """item1, item2, phi, p of a table of associations in any of its usual shapes.

    The names are in ``gene`` (a row belongs to it alone), in ``feature1`` and ``feature2``,
    in ``item1`` and ``item2``, or else in the first column; case doesn't matter.  phi and p
    are 0 and 1 where the table has none.
    """
    by = {c.lower(): c for c in df.columns}
    pick = lambda *names: next((F.col(f"`{by[n]}`") for n in names if n in by), None)
    one = pick("gene")
    first, second = (one, one) if one is not None else (pick("feature1", "item1"), pick("feature2", "item2"))
    if first is None:
        first = F.col(f"`{df.columns[0]}`")
    phi, p = pick("phi", "association", "mdr_association"), pick("p", "p_value", "raw_p", "adj_p")
    return df.select(first.cast("string").alias("item1"), (first if second is None else second).cast("string").alias("item2"),
                     F.coalesce(phi.cast("double"), F.lit(0.0)).alias("phi") if phi is not None else F.lit(0.0).alias("phi"), F.coalesce(p.cast("double"), F.lit(1.0)).alias("p") if p is not None else F.lit(1.0).alias("p"))


def intervention_targets(edges: DataFrame, paths: DataFrame, communities: DataFrame, associations: DataFrame, modules: DataFrame, prevalence: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Nodes by priority, a weighted sum of association, degree, betweenness, prevalence and mobility.

    association: the largest |phi| of the node's pairs (0 without, p 1); prevalence: given, or
    degree / (nodes - 1); mobility: 1 in a module, .5 in a community of 3 or more, else 0.
    """
    w = TARGET_WEIGHTS | (weights or {})
    associations = named_associations(associations)
    node = graph.degree_centrality(edges).join(graph.betweenness(paths), "id")
    both = associations.select(F.col("item1").alias("id"), "phi", "p").union(associations.select(F.col("item2").alias("id"), "phi", "p"))
    best = both.groupBy("id").agg(F.max_by(F.struct("phi", "p"), F.struct(F.abs("phi"), -F.col("p"))).alias("b")).select("id", F.abs("b.phi").alias("association"), F.col("b.p").alias("p_value"))
    mobile = modules.select(F.explode("genes").alias("id")).distinct().withColumn("in_module", F.lit(True))
    size = communities.join(communities.groupBy("community").agg(F.count("*").alias("size")), "community").select("id", "community", "size")
    full = node.join(best, "id", "left").join(mobile, "id", "left").join(size, "id", "left")
    if prevalence is not None:
        full = full.join(F.broadcast(prevalence.select(F.col("feature").alias("id"), "prevalence")), "id", "left")
    else:
        full = full.withColumn("prevalence", F.lit(None).cast("double"))
    cols = {"association": F.coalesce("association", F.lit(0.0)), "degree": F.col("degree_centrality"), "betweenness": F.col("betweenness"), "prevalence": F.coalesce("prevalence", "degree_centrality"),
            "mobility": F.when(F.col("in_module"), 1.0).when(F.col("size") >= 3, 0.5).otherwise(0.0)}
    out = full.select(F.col("id").alias("gene"), *[v.alias(k) for k, v in cols.items()], F.coalesce("p_value", F.lit(1.0)).alias("p_value"), "community", F.coalesce("in_module", F.lit(False)).alias("in_mge_module"))
    out = out.withColumn("priority", F.round(sum((w[k] * F.col(k) for k in cols), F.lit(0.0)), 12))
    return ranked(out, F.desc("priority"), "gene")


def top_targets(targets: DataFrame, top_n: int = 20, min_association: float = 0.3, min_prevalence: float = 0.1) -> DataFrame:
    kept = targets.where((F.col("association") >= min_association) & (F.col("prevalence") >= min_prevalence))
    return kept.orderBy("rank").limit(top_n)
