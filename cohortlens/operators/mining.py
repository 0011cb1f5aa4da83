"""Patterns of a row, frequent itemsets, association rules, ordered patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import draws, stats
from ..sources.matrix import BinaryMatrix
from ..sources.shared import settled
from . import pairs

NO_PHENOTYPE, NO_GENOTYPE = "No_Resistance", "No_Genes"


def patterns(m: BinaryMatrix, empty: str = NO_PHENOTYPE) -> DataFrame:
    """``row, pattern``: the sorted names of a row's ones, or the fallback's name alone."""
    return m.by_row().select("row", F.when(F.size("has") > 0, F.array_sort("has")).otherwise(F.array(F.lit(empty))).alias("pattern"))


def pattern_frequencies(found: DataFrame) -> DataFrame:
    """``pattern`` (joined by ", "), ``n`` and ``frequency`` in percent."""
    by = settled(found.groupBy(F.array_join("pattern", ", ").alias("pattern")).agg(F.count("*").alias("n")))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("pattern", "n", (F.col("n") * 100 / F.col("total")).alias("frequency"))


def frequent_itemsets(m: BinaryMatrix, min_support: float = 0.1, longest: int | None = None) -> DataFrame:
    """``items`` (sorted by name), ``n``, ``support`` of the itemsets with the least support.

    Spark's parallel FP-growth: two passes over the rows, whatever the length of the
    sets, and no candidates on the driver.  ``longest`` bounds the length; by default
    nothing does.
    """
    from pyspark.ml.fpm import FPGrowth

    # Like rows lie together (a frequent one may fill several tasks), so that tasks' trees share few branches and what is
    # exchanged grows with the patterns, not with patterns times tasks.
    by = settled(m.by_row().select("row", F.array_sort("has").alias("items")))
    rows = settled(by.repartitionByRange("items", F.xxhash64("row")).select("items"))
    n = rows.count()
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(rows).freqItemsets if n else rows.withColumn("freq", F.lit(0).cast("long")).limit(0)
    out = found.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"), (F.col("freq") / max(n, 1)).alias("support"))
    return settled(out if longest is None else out.where(F.size("items") <= longest))


def association_rules(itemsets: DataFrame, min_lift: float = 1.0, min_confidence: float = 0.0) -> DataFrame:
    """All rules antecedent => consequent of the itemsets, with both parts of any length.

    antecedents, consequents (arrays), support, confidence, lift, leverage, conviction
    (infinite where the confidence is 1).
    """
    rules = _divided(itemsets.where(F.size("items") >= 2).select("items", "support"))
    known = itemsets.select("items", "support")
    a = known.select(F.col("items").alias("antecedents"), F.col("support").alias("sa"))
    c = known.select(F.col("items").alias("consequents"), F.col("support").alias("sc"))
    full = rules.join(a, "antecedents").join(c, "consequents")
    confidence = F.col("support") / F.col("sa")
    out = full.withColumn("confidence", confidence).withColumn("lift", F.col("confidence") / F.col("sc"))
    out = out.withColumn("leverage", F.col("support") - F.col("sa") * F.col("sc"))
    out = out.withColumn("conviction", F.when(F.col("confidence") >= 1, F.lit(float("inf"))).otherwise((1 - F.col("sc")) / (1 - F.col("confidence"))))
    return out.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence)).select("antecedents", "consequents", "support", "confidence", "lift", "leverage", "conviction")


#: Length of sets that are divided at once, by the numbers below 2^length; longer ones are divided item by item.
AT_ONCE = 12


def _divided(sets: DataFrame) -> DataFrame:
    """support, antecedents, consequents: all ways to part a set in two, each side in the set's order.

    Longer sets start with one consequent and move one item after another, each behind
    the last moved, so that every division is made once and no row is wider than its set.
    """
    short = sets.where(F.size("items") <= AT_ONCE)
    cut = short.select("items", "support", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)).alias("mask"))
    side = lambda bit: F.filter("items", lambda x, i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)) == bit)
    out = cut.select("support", side(1).alias("antecedents"), side(0).alias("consequents"))
    longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    if longest <= AT_ONCE:
        return out
    level = sets.where(F.size("items") > AT_ONCE).select("support", F.col("items").alias("antecedents"), F.array().cast("array<string>").alias("consequents"))
    for _ in range(longest - 1):
        last = F.coalesce(F.try_element_at("consequents", F.lit(-1)), F.lit(""))
        moved = level.where(F.size("antecedents") > 1).select("*", F.explode(F.filter("antecedents", lambda x: (F.size("consequents") == 0) | (x > last))).alias("x"))
        level = settled(moved.select("support", F.array_remove("antecedents", F.col("x")).alias("antecedents"), F.concat("consequents", F.array("x")).alias("consequents")))
        out = out.union(level)
    return out


def rule_view(rules: DataFrame) -> DataFrame:
    """Three digits, as reports show them; parts joined by ", "."""
    num = [F.bround(c, 3).alias(c) for c in ("support", "confidence", "lift", "leverage", "conviction")]
    return rules.select(F.array_join("antecedents", ", ").alias("antecedents"), F.array_join("consequents", ", ").alias("consequents"), *num).orderBy(F.desc("lift"), "antecedents", "consequents")


def pair_tables(m: BinaryMatrix) -> DataFrame:
    """Tables of all pairs of features with their correlation ``r``, settled: one pass over the rows for all that follows."""
    return settled(pairs.contingency(m, every=True).withColumn("r", stats.phi(*[F.col(c) for c in ("n00", "n01", "n10", "n11")])))


def directed_edges(tables: DataFrame, min_r: float = 0.3) -> DataFrame:
    """Both directions of each pair with a correlation above the limit: a, b, oa, ob, r, na, nb, n_ab, n."""
    t = tables.where(F.col("r") > min_r)
    ab = t.select(F.col("item1").alias("a"), F.col("item2").alias("b"), F.col("ord1").alias("oa"), F.col("ord2").alias("ob"), "r", F.col("k1").alias("na"), F.col("k2").alias("nb"), F.col("n11").alias("n_ab"), "n")
    ba = t.select(F.col("item2").alias("a"), F.col("item1").alias("b"), F.col("ord2").alias("oa"), F.col("ord1").alias("ob"), "r", F.col("k2").alias("na"), F.col("k1").alias("nb"), F.col("n11").alias("n_ab"), "n")
    return ab.union(ba)


def _top(edges: DataFrame, k: int) -> DataFrame:
    # digits beyond the tenth are rounding; equal correlations keep the order of the columns
    return edges.orderBy(F.desc(F.round("r", 10)), "oa", "ob").limit(k)


def ordered_pairs(m: BinaryMatrix, min_support: float = 0.1, min_confidence: float = 0.5, min_r: float = 0.3, top: int = 50, tables: DataFrame | None = None, shuffles: int = 0, seed: int = 42) -> DataFrame:
    """A→B among the ``top`` directed edges: path, support, confidence, lift, p_value.

    p is the exact chance, with A and B shuffled against each other, of as many joint rows or more.
    ``tables``: the matrix's ``pair_tables``, where they are at hand.
    """
    e = _top(directed_edges(pair_tables(m) if tables is None else tables, min_r), top)
    support, confidence = F.col("n_ab") / F.col("n"), F.col("n_ab") / F.col("na")
    p = stats.upper_tail_p(F.col("n") - F.col("na") - F.col("nb") + F.col("n_ab"), F.col("nb") - F.col("n_ab"), F.col("na") - F.col("n_ab"), F.col("n_ab"))
    if shuffles:
        # a shuffle of B has a joint count from this distribution: its draw u tells whether the count reaches the one seen
        u = lambda b: draws.unit_md5_column(F.lit(seed), F.concat_ws("→", "a", "b"), b)
        reached = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(shuffles - 1)), F.lit(0), lambda s, b: s + (u(b) > 1 - p).cast("int"))
        p = stats.bind(p, reached) / shuffles
    out = e.select(F.array("a", "b").alias("path"), support.alias("support"), confidence.alias("confidence"), (confidence / (F.col("nb") / F.col("n"))).alias("lift"), p.alias("p_value"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def ordered_triplets(m: BinaryMatrix, min_support: float = 0.1, min_confidence: float = 0.5, min_r: float = 0.3, top: int = 20, tables: DataFrame | None = None, exact_p: bool = False) -> DataFrame:
    """A→B→C: an edge A→B and a C that starts an edge, both among the ``top``; each path once.

    confidence = P(B|A) P(C|B), lift = confidence / P(C); p_value is the constant 0.05, or with
    ``exact_p`` that of ``chain_p``.
    Joint counts of B and C are in the pair tables; those of all three come from one pass,
    in which rows with the same of these features are one.
    """
    tables = pair_tables(m) if tables is None else tables
    e = settled(_top(directed_edges(tables, min_r), top))
    third = e.select(F.col("a").alias("c"), F.col("oa").alias("oc"), F.col("na").alias("nc")).distinct()
    n_edges = e.agg(F.count("*").alias("edges"))
    want = e.join(third, (F.col("c") != F.col("a")) & (F.col("c") != F.col("b"))).crossJoin(n_edges).where("edges >= 3").select("a", "b", "c", "oa", "ob", "oc", "na", "nb", "nc", "n_ab", "n").distinct()
    want = settled(want)  # at most top * top rows
    used = want.select(F.explode(F.array(F.struct(F.col("a").alias("feature"), F.col("oa").alias("ord")), F.struct(F.col("b").alias("feature"), F.col("ob").alias("ord")))).alias("x")).select("x.*").distinct()
    codes = m.ones.join(F.broadcast(used), "feature").groupBy("row").agg(F.array_sort(F.collect_set("ord")).alias("has")).groupBy("has").agg(F.count("*").alias("times"))
    names = want.agg(F.collect_set(F.struct("oa", "ob", "oc")).alias("w"))
    held = F.filter("w", lambda x: F.array_contains("has", x["oa"]) & F.array_contains("has", x["ob"]) & F.array_contains("has", x["oc"]))
    abc = codes.crossJoin(F.broadcast(names)).select(F.explode(held).alias("t"), "times").groupBy("t.oa", "t.ob", "t.oc").agg(F.sum("times").alias("n_abc"))
    bc = tables.select(F.least("ord1", "ord2").alias("lo"), F.greatest("ord1", "ord2").alias("hi"), F.col("n11").alias("n_bc"))
    full = want.withColumn("lo", F.least("ob", "oc")).withColumn("hi", F.greatest("ob", "oc")).join(abc, ["oa", "ob", "oc"], "left").join(bc, ["lo", "hi"], "left").na.fill(0, ["n_abc", "n_bc"])
    confidence = (F.col("n_ab") / F.col("na")) * (F.col("n_bc") / F.col("nb"))
    p = F.lit(0.05)
    if exact_p:
        full, p = chain_p(full), F.col("p")
    out = full.select(F.array("a", "b", "c").alias("path"), (F.col("n_abc") / F.col("n")).alias("support"), confidence.alias("confidence"), (confidence / (F.col("nc") / F.col("n"))).alias("lift"), p.alias("p_value"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def chain_p(paths: DataFrame) -> DataFrame:
    """Adds p to (a, b, c, na, nb, nc, n, n_ab, n_bc): the chance that shuffles give P(B|A) P(C|B) at least as large.

    A and C are shuffled against B, each on its own, so both joint counts are
    hypergeometric and independent: for each count of A and B that has a chance, the
    tail of the counts of B and C that make up the product.
    """
    seen = F.col("n_ab") * F.col("n_bc")
    spread = paths.withColumn("s", stats.likely_support(F.col("na"), F.col("nb"), F.col("n"))).withColumn("x", F.explode(F.sequence("s.low", "s.high")))
    low, high = F.greatest(F.lit(0), F.col("nb") + F.col("nc") - F.col("n")), F.least("nb", "nc")
    y = F.greatest(low, F.when(seen == 0, F.lit(0)).otherwise(F.ceil(seen / F.col("x")))).cast("long")
    spread = spread.withColumn("y", F.when((F.col("x") > 0) | (seen == 0), y)).where(F.col("y") <= high)
    # tails of all counts of B and C by one sum from above; counts beyond the likely ones have the tail of the nearest
    margins = paths.select("nb", "nc", "n").distinct()
    counts = margins.withColumn("s", stats.likely_support(F.col("nb"), F.col("nc"), F.col("n"))).select("nb", "nc", "n", "s", F.explode(F.sequence("s.low", "s.high")).alias("y"))
    counts = counts.repartition("nb", "nc", "y").withColumn("q", stats.hypergeometric(F.col("y"), F.col("nb"), F.col("nc"), F.col("n")))
    above = Window.partitionBy("nb", "nc", "n").orderBy(F.desc("y"))
    tails = settled(counts.select("nb", "nc", "n", "y", F.sum("q").over(above).alias("tail")))
    likely = stats.likely_support(F.col("nb"), F.col("nc"), F.col("n"))
    chance = stats.hypergeometric(F.col("x"), F.col("na"), F.col("nb"), F.col("n"))
    spread = spread.repartition("a", "b", "c", "x").withColumn("y", F.greatest("y", likely["low"])).join(tails, ["nb", "nc", "n", "y"])
    by = spread.withColumn("_p", chance * F.least(F.lit(1.0), F.col("tail"))).groupBy("a", "b", "c").agg(F.sum("_p").alias("_p"))
    return paths.join(by, ["a", "b", "c"], "left").withColumn("p", F.least(F.lit(1.0), F.coalesce("_p", F.lit(0.0)))).drop("_p")


def ordered_patterns(m: BinaryMatrix, min_support: float = 0.1, min_confidence: float = 0.5, min_r: float = 0.3) -> DataFrame:
    """Pairs and triplets: pattern ("A→B→C"), support, confidence, lift, p_value."""
    tables = pair_tables(m)
    both = ordered_pairs(m, min_support, min_confidence, min_r, tables=tables).union(ordered_triplets(m, min_support, min_confidence, min_r, tables=tables))
    return both.select(F.concat_ws("→", "path").alias("pattern"), "support", "confidence", "lift", "p_value")

