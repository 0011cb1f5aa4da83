"""Operators whose contract is known and whose formulas are ours: bootstrap of rules and
networks, entropy-weighted importance, stability, redundancy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import binary_entropy
from ..sources.matrix import BinaryMatrix
from ..sources.shared import settled
from . import bootstrap, graph, mining, ordering, pairs, strata


def redundant_pairs(m: BinaryMatrix, threshold: float = 0.9) -> DataFrame:
    """feature1, feature2, jaccard above the threshold."""
    j = pairs.jaccard_distances(m).select(F.col("item1").alias("feature1"), F.col("item2").alias("feature2"), (1 - F.col("distance")).alias("jaccard"))
    return j.where(F.col("jaccard") > threshold)


def entropy_weighted(m: BinaryMatrix, importance: DataFrame, penalty: float = 0.5) -> DataFrame:
    """feature, base_importance, entropy, adjusted_importance = base (1 - penalty (1 - entropy))."""
    p = pairs.prevalence(m).select("feature", binary_entropy(F.col("prevalence")).alias("entropy"))
    full = importance.select("feature", F.col("importance").alias("base_importance")).join(F.broadcast(p), "feature")
    return full.withColumn("adjusted_importance", F.col("base_importance") * (1 - penalty * (1 - F.col("entropy"))))


#: Text of the itemsets that are looked up in a row at once.
SETS_BYTES = 8 << 20


def _sets_held(has: DataFrame, block: DataFrame) -> DataFrame:
    """row, keys of the block's sets (key, items) that are within ``has``; the block has a bounded size.

    Sets go by their first item, so that a row looks at those only that begin with one of its features.
    """
    first = block.groupBy(F.col("items")[0].alias("first")).agg(F.collect_list(F.struct("key", "items")).alias("sets"))
    wanted = first.agg(F.map_from_entries(F.collect_list(F.struct("first", "sets"))).alias("by"))
    near = F.flatten(F.filter(F.transform("has", lambda f: F.try_element_at("by", f)), lambda x: x.isNotNull()))
    held = F.transform(F.filter(near, lambda s: F.size(F.array_except(s["items"], F.col("has"))) == 0), lambda s: s["key"])
    return has.crossJoin(F.broadcast(wanted)).select("row", held.alias("keys"))


def rules_with_intervals(m: BinaryMatrix, min_support: float = 0.05, min_confidence: float = 0.7, replicates: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Rules with percentile limits of their lift over row resamples; significant if the interval excludes 1.

    The rows that hold both parts, the antecedent, or the consequent are counted with
    all replicates' weights, in one pass over the rows for each block of ``SETS_BYTES``
    of itemsets: the sets stay a table, of which a task holds one block.
    """
    sets = mining.frequent_itemsets(m, min_support)
    rules = mining.association_rules(sets, 0.0, min_confidence).select("antecedents", "consequents", "support", "confidence", "lift")
    names = settled(rules.select(F.explode(F.array("antecedents", "consequents", F.array_sort(F.array_union("antecedents", "consequents")))).alias("items")).distinct())
    known = settled(ordering.numbered(names, ["items"], "at").select((F.col("at") - 1).alias("key"), "items"))
    sets, longest = known.agg(F.count(F.lit(1)), F.max(F.octet_length(F.array_join("items", ",")))).first()
    has = settled(m.rows.join(m.ones.groupBy("row").agg(F.collect_set("feature").alias("has")), "row", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>"))))
    size = max(1, SETS_BYTES // max(1, longest or 1))
    n = settled(bootstrap.weight_sums(has.select("row", F.array(F.lit(bootstrap.ALL).cast("long")).alias("keys")), replicates, seed))
    for first in range(0, sets, size):
        n = n.unionByName(settled(bootstrap.weight_sums(_sets_held(has, known.where(F.col("key").between(first, first + size - 1))), replicates, seed)))
    counts = n.where("n > 0").join(known, "key").select("items", "replicate", "n")
    total = n.where(F.col("key") == bootstrap.ALL).select("replicate", F.col("n").alias("total"))
    key = lambda name, count: counts.select(F.col("items").alias(name), "replicate", F.col("n").alias(count))
    full = rules.withColumn("both", F.array_sort(F.array_union("antecedents", "consequents"))).join(key("both", "nb"), "both")
    full = full.join(key("antecedents", "na"), ["antecedents", "replicate"]).join(key("consequents", "nc"), ["consequents", "replicate"]).join(F.broadcast(total), "replicate")  # a row for each replicate
    lift = F.col("nb") * F.col("total") / (F.col("na") * F.col("nc"))
    limits = full.groupBy("antecedents", "consequents").agg(F.percentile(lift, F.lit((1 - confidence) / 2)).alias("lift_ci_lower"), F.percentile(lift, F.lit((1 + confidence) / 2)).alias("lift_ci_upper"))
    out = rules.join(limits, ["antecedents", "consequents"])
    return out.withColumn("is_significant", (F.col("lift_ci_lower") > 1) | (F.col("lift_ci_upper") < 1))


def edge_confidence(m: BinaryMatrix, edge_function: Callable[[DataFrame], DataFrame], replicates: int = 500, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """src, dst, confidence, high_confidence: how often an edge recurs over row resamples.

    ``edge_function`` is given (replicate, has, n) of all replicates (see
    ``bootstrap.resamples``) and returns (replicate, src, dst): one plan, however many
    replicates.  ``network_by_replicate`` is the network's own.
    """
    found = edge_function(bootstrap.resamples(m, replicates, seed)).select("replicate", "src", "dst").distinct()
    by = found.groupBy("src", "dst").agg((F.count("*") / replicates).alias("confidence"))
    return by.withColumn("high_confidence", F.col("confidence") >= threshold)


def network_by_replicate(alpha: float = 0.05, method: str = "fdr_bh") -> Callable[[DataFrame], DataFrame]:
    """An edge function: the significant pairs of each replicate, src < dst by name."""

    def edges(rows: DataFrame) -> DataFrame:
        counts = settled(strata.cell_counts(rows, ["replicate"], "has", weight="n"))
        tests = strata.associations(counts, ["replicate"], method=method)
        return tests.where(F.col("adj_p") <= alpha).select("replicate", F.col("item1").alias("src"), F.col("item2").alias("dst"))

    return edges


def pattern_recurrence(m: BinaryMatrix, pattern_function: Callable[[DataFrame], DataFrame], replicates: int = 500, seed: int = 42) -> DataFrame:
    """feature, stability: percent of row resamples in which ``pattern_function`` finds a feature.

    It is given (replicate, has, n) of all replicates and returns (replicate, feature).
    """
    found = pattern_function(bootstrap.resamples(m, replicates, seed)).select("replicate", "feature").distinct()
    by = found.groupBy("feature").agg((F.count("*") * 100 / replicates).alias("stability"))
    return m.features.select("feature").join(by, "feature", "left").na.fill(0.0, ["stability"])


def network_confidence(m: BinaryMatrix, replicates: int = 500, threshold: float = 0.8, seed: int = 42, alpha: float = 0.05, method: str = "fdr_bh") -> DataFrame:
    """``edge_confidence`` of ``graph.network_edges``: joint counts of all replicates come from one pass over the rows."""
    size = m.features.agg(F.max("ord").alias("top")).first()["top"] + 1
    coded = m.ones.join(F.broadcast(m.features.select("feature", "ord")), "feature").groupBy("row").agg(F.array_sort(F.collect_set("ord")).alias("f"))
    # A pair's key is ord1 * size + ord2, a feature's is that of its pair with itself.
    cells = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 1, F.size("f")), lambda b: a.cast("long") * size + b)))
    keys = F.concat(F.array(F.lit(bootstrap.ALL).cast("long")), F.coalesce(cells, F.array().cast("array<long>")))
    n = settled(bootstrap.weight_sums(m.rows.join(coded, "row", "left").select("row", keys.alias("keys")), replicates, seed))  # read four times
    total = n.where(F.col("key") == bootstrap.ALL).select("replicate", "n").where("n > 0")
    cell = n.where("key >= 0").select((F.floor(F.col("key") / size)).cast("int").alias("ord1"), (F.col("key") % size).cast("int").alias("ord2"), "replicate", F.col("n").alias("n11"))
    ones = cell.where("ord1 = ord2").select("replicate", F.col("ord1").alias("ord"), F.col("n11").alias("k"))
    p = ones.join(F.broadcast(total), "replicate").where("k > 0 and k < n").join(F.broadcast(m.features.select("feature", "role", "ord")), "ord")
    a = p.select("replicate", "n", F.col("feature").alias("item1"), F.col("role").alias("role1"), F.col("ord").alias("ord1"), F.col("k").alias("k1"))
    b = p.select(F.col("replicate").alias("same"), F.col("feature").alias("item2"), F.col("role").alias("role2"), F.col("ord").alias("ord2"), F.col("k").alias("k2"))
    full = a.join(b, (F.col("replicate") == F.col("same")) & (F.col("ord1") < F.col("ord2"))).drop("same").join(cell, ["replicate", "ord1", "ord2"], "left")
    n11 = F.coalesce("n11", F.lit(0)).cast("long")
    tables = full.select("replicate", "item1", "item2", "role1", "role2", "ord1", "ord2", "k1", "k2", "n", (F.col("n") - F.col("k1") - F.col("k2") + n11).alias("n00"),
                         (F.col("k2") - n11).alias("n01"), (F.col("k1") - n11).alias("n10"), n11.alias("n11"))
    edges = pairs.adjust(pairs.tested(tables), method=method, by=("replicate",)).where(F.col("adj_p") <= alpha)
    by = edges.groupBy(F.col("item1").alias("src"), F.col("item2").alias("dst")).agg((F.count("*") / replicates).alias("confidence"))
    return by.withColumn("high_confidence", F.col("confidence") >= threshold)


def pattern_stability(m: BinaryMatrix, min_share: float = 0.1, replicates: int = 500, seed: int = 42, found: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """feature, stability: percent of row resamples in which a feature is found.

    ``found`` says so from a resample's count of the feature and of rows; by default it is
    a share of ``min_share`` or more.
    """
    test = found or (lambda n, total: n >= min_share * total)
    n = bootstrap.feature_sums(m, replicates, seed)
    total = n.where(F.col("key") == bootstrap.ALL).select("replicate", F.col("n").alias("total"))
    names = m.features.select("feature", F.col("ord").cast("long").alias("key"))
    hits = n.where("n > 0").join(F.broadcast(names), "key").join(F.broadcast(total), "replicate")
    by = hits.groupBy("feature").agg((F.sum(test(F.col("n"), F.col("total")).cast("long")) * 100 / replicates).alias("stability"))
    return m.features.select("feature").join(by, "feature", "left").na.fill(0.0, ["stability"])


def comprehensive(m: BinaryMatrix, importance: DataFrame | None = None, edge_function: Callable | None = None, replicates: int = 500) -> dict[str, DataFrame]:
    """Rules and redundancy always, the others where their input is given."""
    out = {"association_rules": rules_with_intervals(m, replicates=replicates), "redundancy": redundant_pairs(m)}
    if edge_function is not None:
        out["network"] = network_confidence(m, replicates) if edge_function is graph.network_edges else edge_confidence(m, edge_function, replicates)
    if importance is not None:
        out["importance"] = entropy_weighted(m, importance)
        out["stability"] = pattern_stability(m, replicates=replicates)
    return out
