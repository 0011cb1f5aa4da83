"""Registered queries, one for each operator, with the SQL twin where SQL can express it.

All run on whole tables.  The matrices are those of ``sources.matrix.star_matrix``
(orders by brands and line flags) and of ``_parts`` (parts by brand and size, whose
small expected counts take the exact test).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import draws, stats, text
from ..operators import advanced, bootstrap, charts, communities, graph, mining, ordering, pages, pairs, patterns, resistance, scores, synth, tiles, validation
from ..sources.matrix import FEATURES, BinaryMatrix, feature_roles, star_matrix
from ..sources.shared import settled
from . import oracles as o
from .oracles import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> BinaryMatrix:
    part = _read(spark, d, "part")
    ones = part.select(F.col("p_partkey").alias("row"), F.explode(F.array(F.col("p_brand"), F.concat(F.lit("size_"), F.col("p_size").cast("string")))).alias("feature")).distinct()
    names = sorted(r[0] for r in ones.select("feature").distinct().collect())  # one for each column
    return BinaryMatrix(ones, part.select(F.col("p_partkey").alias("row")), spark.createDataFrame([(n, "gene", i, None) for i, n in enumerate(names)], FEATURES))


def _classes_and_genes(m: BinaryMatrix) -> BinaryMatrix:
    genes = m.role("gene")
    genes.features = genes.features.withColumn("ord", F.col("ord") + 100)
    return m.class_level().union(genes)


def _edges(m: BinaryMatrix) -> DataFrame:
    return settled(graph.network_edges(m))


def _communities(m: BinaryMatrix) -> DataFrame:
    """A given partition, so that what follows has a SQL twin."""
    return m.features.select(F.col("feature").alias("id"), (F.col("ord") % 5 + 1).alias("community"))


def _tests(m: BinaryMatrix) -> DataFrame:
    return settled(pairs.tested(pairs.contingency(m)))


# ---- sources, projections, filters ------------------------------------------------------------


def _seen(m: BinaryMatrix) -> DataFrame:
    """The features that occur in the rows."""
    return m.features.join(m.ones.select("feature").distinct(), "feature", "left_semi")


@query("s3_feature_roles", sql("SELECT f AS feature, role, ord, class FROM feats WHERE f IN (SELECT f FROM ones)"))
def _(s, d):
    return _seen(star_matrix(s, d)).select("feature", "role", "ord", "class")


@query("u3_skipped_columns", """SELECT unnest(['o_custkey', 'o_orderdate', 'o_orderkey', 'o_orderstatus', 'o_totalprice']) AS feature, unnest([2, 5, 1, 3, 4]) - 1 AS ord, unnest([n1, n2, n3, n4, n5]) AS n_values FROM (
    SELECT count(o_custkey) AS n1, count(o_orderdate) AS n2, count(o_orderkey) AS n3, count(o_orderstatus) AS n4, count(o_totalprice) AS n5 FROM orders)""")
def _(s, d):
    """The columns of a wide table that aren't skipped, with the values they hold."""
    orders = _read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    roles = feature_roles(orders.columns, skipped=("o_orderpriority",))
    counts = orders.agg(*[F.count(name).alias(name) for name, *_ in roles])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(at).alias("ord"), F.col(name).alias("n_values")) for name, _, at, _ in roles])))


@query("s6_full_outer_align", sql("""SELECT coalesce(a.r, b.r) AS isolate, a.n_pheno, b.n_gene FROM (SELECT r, count(*) AS n_pheno FROM pones GROUP BY r) a
    FULL OUTER JOIN (SELECT r, count(*) AS n_gene FROM gones GROUP BY r) b ON a.r = b.r"""))
def _(s, d):
    m = star_matrix(s, d)
    a = m.role("phenotype").ones.groupBy(F.col("row").alias("isolate")).agg(F.count("*").alias("n_pheno"))
    return a.join(m.role("gene").ones.groupBy(F.col("row").alias("isolate")).agg(F.count("*").alias("n_gene")), "isolate", "full_outer")


@query("p1_class_resistance", sql("SELECT rws.r AS isolate, " + ", ".join(f"coalesce(max((f = '{c}')::INT), 0) AS {c}" for c in o.DRUG_CLASSES) + " FROM rws LEFT JOIN cones ON cones.r = rws.r GROUP BY rws.r"))
def _(s, d):
    return resistance.class_resistance(star_matrix(s, d)).withColumnRenamed("row", "isolate")


@query("p2_mdr_flags", sql("SELECT r AS isolate, n_classes, is_mdr FROM flags"))
def _(s, d):
    return resistance.multiresistance(star_matrix(s, d)).withColumnRenamed("row", "isolate")


@query("p3_mdr_subset", sql("SELECT f AS feature, count(*) AS n FROM ones WHERE r IN (SELECT r FROM mrows) GROUP BY f"))
def _(s, d):
    return resistance.mdr_subset(star_matrix(s, d)).ones.groupBy("feature").agg(F.count("*").alias("n"))


@query("p4_gene_binarise", """SELECT o_orderkey, trunc(o_totalprice)::INT AS o_totalprice, (o_orderstatus IS NOT NULL AND o_orderstatus <> '')::INT AS o_orderstatus, priority FROM (
    SELECT o_orderkey, o_totalprice, o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS priority FROM orders)""")
def _(s, d):
    orders = _read(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("priority"))
    return resistance.binarise_genes(orders, ["o_totalprice", "o_orderstatus", "priority"], "o_orderkey")


@query("p5_hybrid_binarise", "SELECT event_id, coalesce((value <> 0)::INT, 0) AS flag, coalesce((value <> 0)::INT, 1) AS flag_null_is_one FROM events")
def _(s, d):
    return _read(s, d, "events").select("event_id", resistance.hybrid_binary(F.col("value")).alias("flag"), resistance.hybrid_binary(F.col("value"), True).alias("flag_null_is_one"))


@query("p6_fast_mdr_count", sql("SELECT sum((k >= 3)::INT)::BIGINT AS n_mdr, round(avg((k >= 3)::INT), 6) AS prevalence FROM (SELECT rws.r, count(f) AS k FROM rws LEFT JOIN ones ON ones.r = rws.r GROUP BY rws.r)"))
def _(s, d):
    return resistance.fast_mdr_count(star_matrix(s, d)).select("n_mdr", *r6("prevalence"))


@query("p11_binary_encoding", """SELECT 'l_linenumber' AS "column", bool_and(l_linenumber IN (0, 1)) AS is_binary FROM lineitem UNION ALL SELECT 'l_quantity', bool_and(l_quantity IN (0, 1)) FROM lineitem
    UNION ALL SELECT 'flag', true""")
def _(s, d):
    t = _read(s, d, "lineitem").select("l_linenumber", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    return resistance.binary_encoding(t)


@query("p12_downcast", "SELECT l_linenumber::INT AS l_linenumber, count(*) AS n, round(avg(l_quantity::FLOAT), 6) AS mean_quantity FROM lineitem GROUP BY l_linenumber")
def _(s, d):
    t = resistance.downcast(_read(s, d, "lineitem").select("l_linenumber", "l_quantity"))
    return t.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query("p13_density", sql("""SELECT n_ones, n_cells, round(n_ones / n_cells, 6) AS density, n_ones / n_cells > 0.3 AS is_dense FROM (
    SELECT (SELECT count(*) FROM ones) AS n_ones, (SELECT count(*) FROM rws) * (SELECT count(*) FROM feats) AS n_cells)"""))
def _(s, d):
    return resistance.density(star_matrix(s, d)).select("n_ones", "n_cells", *r6("density"), "is_dense")


# ---- joins and aggregates ---------------------------------------------------------------------


@query("j1_feature_pairs", sql("SELECT a.f AS item1, b.f AS item2 FROM feats a JOIN feats b ON a.ord < b.ord WHERE a.f IN (SELECT f FROM ones) AND b.f IN (SELECT f FROM ones)"))
def _(s, d):
    f = settled(_seen(star_matrix(s, d)))
    a, b = f.select(F.col("feature").alias("item1"), F.col("ord").alias("o1")), f.select(F.col("feature").alias("item2"), F.col("ord").alias("o2"))
    return a.join(b, F.col("o1") < F.col("o2")).select("item1", "item2")


@query("j2_phenotype_gene_pairs", sql("SELECT a.f AS phenotype, b.f AS gene FROM pfeats a CROSS JOIN gfeats b WHERE a.f IN (SELECT f FROM ones) AND b.f IN (SELECT f FROM ones)"))
def _(s, d):
    f = settled(_seen(star_matrix(s, d)))
    return f.where("role = 'phenotype'").select(F.col("feature").alias("phenotype")).crossJoin(f.where("role = 'gene'").select(F.col("feature").alias("gene")))


@query("a1_contingency", sql("SELECT item1, item2, n00, n01, n10, n11 FROM hc", o.NETWORK))
def _(s, d):
    return pairs.contingency(star_matrix(s, d), every=True).select("item1", "item2", "n00", "n01", "n10", "n11")


@query("a2_prevalence", sql("SELECT f AS feature, k, n, round(k / n, 6) AS prevalence FROM hk", o.NETWORK))
def _(s, d):
    return pairs.prevalence(star_matrix(s, d)).select("feature", "k", "n", *r6("prevalence"))


@query("a3_pattern_frequency", sql("""SELECT pattern, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS frequency FROM (
    SELECT mrows.r, coalesce(string_agg(f, ', ' ORDER BY f), 'No_Resistance') AS pattern FROM mrows LEFT JOIN mcones ON mcones.r = mrows.r GROUP BY mrows.r) GROUP BY pattern"""))
def _(s, d):
    return mining.pattern_frequencies(mining.patterns(resistance.mdr_subset(star_matrix(s, d)).class_level())).select("pattern", "n", *r6("frequency"))


@query("a4_class_count_histogram", sql("SELECT n_classes, count(*) AS n FROM flags GROUP BY n_classes"))
def _(s, d):
    return resistance.multiresistance(star_matrix(s, d)).groupBy("n_classes").agg(F.count("*").alias("n"))


@query("a5_overview", sql("""SELECT count(*) AS n_isolates, sum(is_mdr::INT)::BIGINT AS n_mdr, round(sum(is_mdr::INT) * 100 / count(*), 6) AS pct_mdr,
    (SELECT count(*) FROM pfeats) AS n_phenotypes, (SELECT count(*) FROM gfeats) AS n_genes FROM flags"""))
def _(s, d):
    m = star_matrix(s, d)
    return validation.overview(m, resistance.multiresistance(m)).select("n_isolates", "n_mdr", *r6("pct_mdr"), "n_phenotypes", "n_genes")


@query("a6_network_summary", sql("""SELECT v AS n_nodes, e AS n_edges, p AS n_pheno, v - p AS n_gene, round(2 * e / v, 6) AS avg_degree, round(2 * e / (v * (v - 1)), 6) AS density FROM (
    SELECT (SELECT count(*) FROM vs) AS v, (SELECT count(*) FROM edges) AS e, (SELECT count(*) FROM vs JOIN pfeats ON id = f) AS p)""", o.NETWORK))
def _(s, d):
    m = star_matrix(s, d)
    return graph.network_summary(_edges(m), m).select("n_nodes", "n_edges", "n_pheno", "n_gene", *r6("avg_degree", "density"))


@query("a8_pattern_statistics", sql("SELECT count(*) AS total_patterns, count(DISTINCT pattern_type) AS unique_types, round(avg(pattern_length), 6) AS avg_pattern_length, max(pattern_length) AS max_pattern_length FROM store", o.NETWORK, STORE := """
store AS (SELECT 'P2_' || item1 || '_' || item2 AS pattern_id, '2-way' AS pattern_type, 2 AS pattern_length, n11 / n AS support, n11 / k1 AS confidence, (n11 / k1) / (k2 / n) AS lift, item1 || ',' || item2 AS genes FROM hc
          UNION ALL SELECT 'P1_' || f, '1-way', 1, k / n, k / n, 1.0, f FROM hk)"""))
def _(s, d):
    return patterns.pattern_statistics(_store(s, d)).select("total_patterns", "unique_types", *r6("avg_pattern_length"), "max_pattern_length")


def _store(s: SparkSession, d: str) -> DataFrame:
    m = star_matrix(s, d)
    t, n = pairs.contingency(m, every=True), F.col("n")
    two = t.select(F.concat(F.lit("P2_"), "item1", F.lit("_"), "item2").alias("pattern_id"), F.lit("2-way").alias("pattern_type"), F.lit(2).alias("pattern_length"), (F.col("n11") / n).alias("support"),
                   (F.col("n11") / F.col("k1")).alias("confidence"), (F.col("n11") / F.col("k1") / (F.col("k2") / n)).alias("lift"), F.concat("item1", F.lit(","), "item2").alias("genes"))
    one = pairs.prevalence(m).select(F.concat(F.lit("P1_"), "feature"), F.lit("1-way"), F.lit(1), "prevalence", "prevalence", F.lit(1.0), "feature")
    return two.union(one)


@query("a8_pattern_summary", sql("""SELECT c AS "column", count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1,
    round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS largest
    FROM (SELECT 'support' AS c, support AS x FROM store UNION ALL SELECT 'confidence', confidence FROM store UNION ALL SELECT 'lift', lift FROM store) WHERE x IS NOT NULL GROUP BY c""", o.NETWORK, STORE))
def _(s, d):
    return patterns.pattern_summary(_store(s, d)).select("column", "n", *r6("mean", "std", "least", "q1", "median", "q3", "largest"))


@query("p7_pattern_query", sql("SELECT pattern_id, round(support, 6) AS support, round(confidence, 6) AS confidence, genes FROM store WHERE support >= 0.05 AND confidence >= 0.15 AND (genes LIKE '%Brand#1%' OR genes LIKE '%flag_R%')", o.NETWORK, STORE))
def _(s, d):
    return patterns.query_patterns(_store(s, d), 0.05, 0.15, ["Brand#1", "flag_R"]).select("pattern_id", *r6("support", "confidence"), "genes")


@query("w9_pattern_page", sql("SELECT pattern_id, round(support, 6) AS support FROM store ORDER BY store.support DESC, confidence DESC, pattern_id LIMIT 25 OFFSET 50", o.NETWORK, STORE))
def _(s, d):
    return patterns.query_patterns(_store(s, d), page=3, page_size=25).select("pattern_id", *r6("support"))


@query("k8_top_patterns", sql("SELECT pattern_id, round(support, 6) AS support FROM store ORDER BY store.support DESC, confidence DESC, pattern_id LIMIT 100", o.NETWORK, STORE))
def _(s, d):
    return patterns.top_patterns(_store(s, d), 100).select("pattern_id", *r6("support"))


@query("a9_class_distribution", sql("""SELECT CASE WHEN n_classes >= 9 THEN 'PDR' WHEN n_classes >= 6 THEN 'XDR' WHEN is_mdr THEN 'MDR' ELSE 'non-MDR' END AS category, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM flags GROUP BY 1"""))
def _(s, d):
    return resistance.class_distribution(resistance.multiresistance(star_matrix(s, d))).select("category", "n", *r6("share"))


@query("a10_significance_counts", sql("SELECT count(*) AS n_tests, sum((p < 0.05)::INT)::BIGINT AS n_raw, sum((adj_p <= 0.05)::INT)::BIGINT AS n_adjusted, sum((abs(phi) > 0.02)::INT)::BIGINT AS n_strong FROM ha", o.NETWORK))
def _(s, d):
    t = pairs.adjust(pairs.tested(pairs.contingency(star_matrix(s, d))))
    count = lambda c: F.sum(c.cast("long"))
    return t.agg(F.count("*").alias("n_tests"), count(F.col("p") < 0.05).alias("n_raw"), count(F.col("adj_p") <= 0.05).alias("n_adjusted"), count(F.abs("phi") > 0.02).alias("n_strong"))


@query("a11_concordance", sql("SELECT f AS feature, round(avg(same), 6) AS concordance, avg(same) > 0.9 AS high FROM (SELECT feats.f, rws.r, (flags.is_mdr = (ones.f IS NOT NULL))::INT AS same FROM feats CROSS JOIN rws JOIN flags ON flags.r = rws.r LEFT JOIN ones ON ones.r = rws.r AND ones.f = feats.f) GROUP BY f"))
def _(s, d):
    m = star_matrix(s, d)
    flags = resistance.multiresistance(m)
    both = m.ones.join(flags.where("is_mdr").select("row"), "row").groupBy("feature").agg(F.count("*").alias("hit"))
    total = flags.agg(F.sum(F.col("is_mdr").cast("long")).alias("mdr"))
    full = pairs.prevalence(m).join(both, "feature", "left").crossJoin(F.broadcast(total))
    share = (F.col("n") - F.col("mdr") - F.col("k") + 2 * F.coalesce("hit", F.lit(0))) / F.col("n")
    return full.select("feature", F.round(share, 6).alias("concordance"), (share > 0.9).alias("high"))


@query("a12_cooccurrence_matrix", sql("SELECT a.f AS item1, b.f AS item2, count(*) AS n FROM ones a JOIN ones b USING (r) GROUP BY a.f, b.f"))
def _(s, d):
    return pairs.cooccurrence_matrix(star_matrix(s, d))


@query("a13_duplicate_ids", "SELECT l_orderkey AS id, count(*) AS times FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(s, d):
    return validation.duplicate_ids(_read(s, d, "lineitem"), "l_orderkey")


@query("a14_column_stats", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n, round(avg(({c} IS NULL)::INT), 6) AS missing_share, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, sum(coalesce(({c} > 0)::INT, 0))::BIGINT AS n_positive,
    sum(coalesce(({c} = 0)::INT, 0))::BIGINT AS n_negative, min({c}) = max({c}) AS is_constant, bool_and({c} IN (0, 1)) AS is_binary FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def _(s, d):
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return validation.column_summary(_read(s, d, "lineitem").select(cols), cols).select("column", "n", *r6("missing_share", "mean", "std"), "n_positive", "n_negative", "is_constant", "is_binary")


@query("a15_percentiles", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS upper FROM events GROUP BY event_type")
def _(s, d):
    return ordering.quantiles(_read(s, d, "events"), "value", {"lower": 0.025, "median": 0.5, "upper": 0.975}, ("event_type",)).select("event_type", *r6("lower", "median", "upper"))


@query("a17_strongest_association", sql("SELECT gene, round(abs(v.phi), 6) AS association, round(v.p, 6) AS p_value FROM (SELECT gene, arg_max({phi: phi, p: p}, {a: abs(phi), b: -p}) AS v FROM (SELECT item1 AS gene, phi, p FROM ht UNION ALL SELECT item2, phi, p FROM ht) GROUP BY gene)", o.NETWORK))
def _(s, d):
    t = _tests(star_matrix(s, d))
    both = t.select(F.col("item1").alias("gene"), "phi", "p").union(t.select("item2", "phi", "p"))
    return both.groupBy("gene").agg(F.max_by(F.struct("phi", "p"), F.struct(F.abs("phi"), -F.col("p"))).alias("v")).select("gene", F.round(F.abs("v.phi"), 6).alias("association"), F.round("v.p", 6).alias("p_value"))


# ---- statistics -------------------------------------------------------------------------------


@query("t1_association_tests", sql("SELECT item1, item2, round(chi2, 6) AS chi2, round(p, 6) AS p, round(phi, 6) AS phi, CASE WHEN exact THEN 'fisher' ELSE 'chi2' END AS test FROM ht", o.NETWORK))
def _(s, d):
    return pairs.tested(pairs.contingency(star_matrix(s, d))).select("item1", "item2", *r6("chi2", "p", "phi"), "test")


@query("t3_fisher_tests", sql("SELECT item1, item2, round(chi2, 6) AS chi2, round(p, 6) AS p, round(phi, 6) AS phi, CASE WHEN exact THEN 'fisher' ELSE 'chi2' END AS test FROM qt", o.PARTS, o.pairs("q", "psones", "prows", "psfeats")))
def _(s, d):
    return pairs.tested(pairs.contingency(_parts(s, d))).select("item1", "item2", *r6("chi2", "p", "phi"), "test")


@query("t4_adjusted_p", sql("SELECT item1, item2, round(adj_p, 6) AS fdr_bh, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm FROM ha", o.NETWORK))
def _(s, d):
    t = pairs.tested(pairs.contingency(star_matrix(s, d)))
    for method in ("fdr_bh", "bonferroni", "holm"):
        t = pairs.adjust(t, method=method, out=method)
    return t.select("item1", "item2", *r6("fdr_bh", "bonferroni", "holm"))


@query("t4_more_methods", sql("""SELECT item1, item2, round(CASE WHEN p < 1 THEN 1 - pow(1 - p, m) ELSE 1 END, 6) AS sidak, round(max(1 - pow(1 - p, m - rk + 1)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) AS holm_sidak,
    round(least(1, min(p * (m - rk + 1)) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS hochberg, round(least(1, min(p * m / rk * h) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr_by,
    round(least(1, adj_p * CASE WHEN g1 IN (0, m) THEN 1 ELSE (m - g1) / m END), 6) AS fdr_tsbh, round(least(1, adj_p * 1.05::DOUBLE * CASE WHEN g2 IN (0, m) THEN 1 ELSE (m - g2) / m END), 6) AS fdr_tsbky
    FROM (SELECT *, sum((adj_p <= 0.05)::INT) OVER () AS g1, sum((adj_p <= 0.05::DOUBLE / 1.05::DOUBLE)::INT) OVER () AS g2, list_sum(list_transform(range(1, m + 1), lambda i: 1 / i)) AS h FROM ha)""", o.NETWORK))
def _(s, d):
    t = settled(pairs.tested(pairs.contingency(star_matrix(s, d))))
    for method, out in (("sidak", "sidak"), ("holm-sidak", "holm_sidak"), ("simes-hochberg", "hochberg"), ("fdr_by", "fdr_by"), ("fdr_tsbh", "fdr_tsbh"), ("fdr_tsbky", "fdr_tsbky")):
        t = pairs.adjust(t, method=method, out=out)
    return t.select("item1", "item2", *r6("sidak", "holm_sidak", "hochberg", "fdr_by", "fdr_tsbh", "fdr_tsbky"))


@query("t5_class_cooccurrence", sql("SELECT item1, item2, round(phi, 6) AS phi, round(p, 6) AS raw_p, round(adj_p, 6) AS adj_p FROM ka WHERE adj_p <= 0.05", o.pairs("k", "mcones", "mrows", "cfeats")))
def _(s, d):
    return pairs.cooccurrence(resistance.mdr_subset(star_matrix(s, d)).class_level()).select("item1", "item2", *r6("phi", "raw_p", "adj_p"))


@query("t5_gene_cooccurrence", sql("SELECT item1, item2, round(phi, 6) AS phi, round(p, 6) AS raw_p, round(adj_p, 6) AS adj_p FROM ga WHERE adj_p <= 0.05", o.pairs("g", "mgones", "mrows", "gfeats")))
def _(s, d):
    return pairs.cooccurrence(resistance.mdr_subset(star_matrix(s, d)).role("gene")).select("item1", "item2", *r6("phi", "raw_p", "adj_p"))


@query("t6_phenotype_gene", sql("SELECT item1 AS phenotype, item2 AS gene, round(phi, 6) AS phi, round(p, 6) AS raw_p, round(adj_p, 6) AS adj_p FROM ca WHERE adj_p <= 0.05", o.pairs("c", "cgones", "rws", "cgfeats", cross=True)))
def _(s, d):
    return pairs.cooccurrence(_classes_and_genes(star_matrix(s, d)), cross_roles=True).select(F.col("item1").alias("phenotype"), F.col("item2").alias("gene"), *r6("phi", "raw_p", "adj_p"))


@query("t7_stars", sql("SELECT item1, item2, printf('%.3f', p) || CASE WHEN p < 0.001 THEN ' ***' WHEN p < 0.01 THEN ' **' WHEN p < 0.05 THEN ' *' ELSE '' END AS significance FROM ht", o.NETWORK))
def _(s, d):
    return pairs.tested(pairs.contingency(star_matrix(s, d))).select("item1", "item2", stats.stars(F.col("p")).alias("significance"))


@query("t8_exact_intervals", sql("""SELECT f AS feature, round(any_value(k / n), 6) AS mean, round(min(x) FILTER (cdf >= 0.025 - 1e-9) / any_value(n), 6) AS lower, round(min(x) FILTER (cdf >= 0.975 - 1e-9) / any_value(n), 6) AS upper FROM (
    SELECT f, k, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / n) + (n - x) * ln(1 - k / n))) OVER (PARTITION BY f ORDER BY x) AS cdf FROM hk, LATERAL (SELECT unnest(range(0, n + 1)) AS x)) GROUP BY f""", o.NETWORK))
def _(s, d):
    return bootstrap.exact_intervals(pairs.prevalence(star_matrix(s, d))).select("feature", *r6("mean", "lower", "upper"))


def _binomial_sql(counts: str) -> str:
    """Replicates x of (f, k, n) by the inverse distribution function."""
    return f"""
cdf AS (SELECT f, k, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / n) + (n - x) * ln(1 - k / n))) OVER (PARTITION BY f ORDER BY x) AS cdf
        FROM {counts}, LATERAL (SELECT unnest(range(0, n + 1)) AS x) WHERE k > 0 AND k < n),
us AS (SELECT f, b, u FROM ({draws.unit_sql(f"(SELECT f, {draws.name_key_sql('f')} AS fk, b FROM {counts}, range(0, 5000) AS g(b) WHERE k > 0 AND k < n)", "fk", "b", "42")})),
reps AS (SELECT us.f, cdf.x / cdf.n AS x FROM us ASOF JOIN cdf ON us.f = cdf.f AND us.u <= cdf.cdf UNION ALL SELECT f, (k = n)::INT::DOUBLE FROM {counts} WHERE k = 0 OR k = n)"""


@query("t9_bootstrap_ci", sql("SELECT f AS feature, round_even(avg(x) * 100, 3) AS mean, round_even(quantile_cont(x, 0.025) * 100, 3) AS lower, round_even(quantile_cont(x, 0.975) * 100, 3) AS upper FROM reps GROUP BY f", o.NETWORK, _binomial_sql("hk")))
def _(s, d):
    return bootstrap.bootstrap_ci(star_matrix(s, d))


@query("t10_pattern_bootstrap", sql("""SELECT pats.f AS pattern, k AS n, round(k * 100 / n, 6) AS frequency, round(lo * 100, 6) AS lower, round(hi * 100, 6) AS upper
    FROM pats JOIN (SELECT f, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM reps GROUP BY f) q ON q.f = pats.f""", """
pats AS (SELECT f, count(*) AS k, sum(count(*)) OVER ()::BIGINT AS n FROM (SELECT mrows.r, coalesce(string_agg(f, ', ' ORDER BY f), 'No_Resistance') AS f FROM mrows LEFT JOIN mcones ON mcones.r = mrows.r GROUP BY mrows.r) GROUP BY f)""", _binomial_sql("pats")))
def _(s, d):
    found = mining.patterns(resistance.mdr_subset(star_matrix(s, d)).class_level())
    return bootstrap.pattern_intervals(mining.pattern_frequencies(found)).select("pattern", "n", *r6("frequency", "lower", "upper"))


def _weights_sql(replicates: int) -> str:
    return f"""
wts AS MATERIALIZED (SELECT r, b, w FROM (SELECT r, b, {draws.poisson_sql('u')} AS w FROM ({draws.unit_sql(f"(SELECT r, b FROM rws, range(0, {replicates}) AS g(b))", "r", "b", "42")})) WHERE w > 0),
tot AS (SELECT b, sum(w)::BIGINT AS total FROM wts GROUP BY b)"""


def _drawn_sql(estimate: str, replicate: str) -> str:
    """``estimate`` and percentiles of ``replicate`` over the drawn values x (weights w) of each event type."""
    return f"""WITH vals AS (SELECT event_type AS name, event_id AS r, value AS x FROM events WHERE value IS NOT NULL),
    rws AS (SELECT r FROM vals), {_weights_sql(1000)},
    reps AS (SELECT name, b, {replicate} AS v FROM vals JOIN wts ON wts.r = vals.r GROUP BY name, b)
    SELECT e.name, round(e.estimate, 6) AS estimate, round(lo, 6) AS lower, round(hi, 6) AS upper FROM (SELECT name, {estimate} AS estimate FROM vals GROUP BY name) e
    JOIN (SELECT name, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM reps GROUP BY name) q ON q.name = e.name"""


def _events(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("row"), "value")


@query("t11_grouped_bootstrap", _drawn_sql("median(x)", "list_median(flatten(list(list_transform(range(w), lambda i: x))))"))
def _(s, d):
    return bootstrap.grouped_statistic(_events(s, d), "median", 1000).select("name", *r6("estimate", "lower", "upper"))


@query("t11_grouped_deviations", _drawn_sql("stddev_pop(x)", "sqrt(greatest(0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)))"))
def _(s, d):
    return bootstrap.grouped_statistic(_events(s, d), "std", 1000).select("name", *r6("estimate", "lower", "upper"))


_FEATURE_SUMS = "sums AS (SELECT f, b, sum(w)::BIGINT AS n FROM wts JOIN ones ON ones.r = wts.r GROUP BY f, b)"


@query("t12_joint_bootstrap", sql("""SELECT feats.f AS feature, round(avg(coalesce(n, 0) / total), 6) AS mean, round(quantile_cont(coalesce(n, 0) / total, 0.025), 6) AS lower, round(quantile_cont(coalesce(n, 0) / total, 0.975), 6) AS upper
    FROM feats CROSS JOIN tot LEFT JOIN sums ON sums.f = feats.f AND sums.b = tot.b GROUP BY feats.f""", _weights_sql(1000), _FEATURE_SUMS))
def _(s, d):
    return bootstrap.joint_intervals(star_matrix(s, d), 1000).select("feature", *r6("mean", "lower", "upper"))


@query("t13_plain_chi2", sql(f"SELECT item1, item2, round({o.PLAIN}, 6) AS statistic, round({o.erfc('sqrt((' + o.PLAIN + ') / 2)')}, 6) AS p FROM hc", o.NETWORK))
def _(s, d):
    return pairs.pairwise_tests(star_matrix(s, d)).select("item1", "item2", *r6("statistic", "p"))


@query("t14_phi_matrix", sql(f"SELECT item1, item2, round(phi, 6) AS phi FROM hv UNION ALL SELECT item2, item1, round(phi, 6) FROM hv", o.NETWORK))
def _(s, d):
    return pairs.phi_matrix(star_matrix(s, d)).select("item1", "item2", *r6("phi"))


@query("t15_pairwise_fisher", sql(f"SELECT item1, item2, 0.0::DOUBLE AS statistic, round({o.FISHER}, 6) AS p FROM qv", o.PARTS, o.pairs("q", "psones", "prows", "psfeats")))
def _(s, d):
    return pairs.pairwise_tests(_parts(s, d), "fisher").select("item1", "item2", "statistic", *r6("p"))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("t16_pearson", " UNION ALL ".join(f"SELECT '{a}' AS item1, '{b}' AS item2, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]))
def _(s, d):
    return pairs.pearson_wide(_read(s, d, "lineitem").select(_NUMERIC), _NUMERIC).select("item1", "item2", *r6("r"))


@query("t17_permutation_p", sql(f"SELECT item1, item2, round({o.UPPER}, 6) AS p FROM qv", o.PARTS, o.pairs("q", "psones", "prows", "psfeats")))
def _(s, d):
    p = stats.upper_tail_p(*[F.col(c) for c in ("n00", "n01", "n10", "n11")])
    return pairs.contingency(_parts(s, d)).select("item1", "item2", F.round(p, 6).alias("p"))


@query("t18_jaccard_distance", sql("SELECT item1, item2, round(CASE WHEN k1 + k2 - n11 = 0 THEN 0 ELSE 1 - n11 / (k1 + k2 - n11) END, 6) AS distance FROM hc", o.NETWORK))
def _(s, d):
    return pairs.jaccard_distances(star_matrix(s, d)).select("item1", "item2", *r6("distance"))


# ---- mining -----------------------------------------------------------------------------------


@query("m1_phenotype_patterns", sql("SELECT rws.r AS isolate, coalesce(string_agg(f, ', ' ORDER BY f), 'No_Resistance') AS pattern FROM rws LEFT JOIN cones ON cones.r = rws.r GROUP BY rws.r"))
def _(s, d):
    return mining.patterns(star_matrix(s, d).class_level()).select(F.col("row").alias("isolate"), F.array_join("pattern", ", ").alias("pattern"))


@query("m2_gene_patterns", sql("SELECT rws.r AS isolate, coalesce(string_agg(f, ', ' ORDER BY f), 'No_Genes') AS pattern FROM rws LEFT JOIN gones ON gones.r = rws.r GROUP BY rws.r"))
def _(s, d):
    return mining.patterns(star_matrix(s, d).role("gene"), mining.NO_GENOTYPE).select(F.col("row").alias("isolate"), F.array_join("pattern", ", ").alias("pattern"))


def _itemsets_sql(ones: str, least: float) -> str:
    """Itemsets of any length, each with the rows that hold it."""
    return f"""
n_ AS (SELECT count(*) AS n FROM rws),
i1 AS (SELECT f, list(r) AS tids FROM {ones} GROUP BY f HAVING count(*) >= {least} * (SELECT n FROM n_)),
grown AS (SELECT [f] AS items, f AS last, tids FROM i1
          UNION ALL SELECT list_append(g.items, i1.f), i1.f, list_intersect(g.tids, i1.tids) FROM grown g JOIN i1 ON i1.f > g.last WHERE len(list_intersect(g.tids, i1.tids)) >= {least} * (SELECT n FROM n_)),
sets AS (SELECT items, tids, len(tids) / n AS s FROM grown, n_),
cut AS (SELECT items, s, unnest(range(1, (1 << len(items)) - 1)) AS m FROM sets WHERE len(items) > 1),
parts_ AS (SELECT items, s, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS a, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS c FROM cut),
rules AS (SELECT p.items, p.s, p.a, p.c, x.s AS sa, y.s AS sc FROM parts_ p JOIN sets x ON x.items = p.a JOIN sets y ON y.items = p.c)"""


def _rules_sql(ones: str, least: float) -> str:
    return sql("""SELECT array_to_string(a, ', ') AS antecedents, array_to_string(c, ', ') AS consequents, round(s, 6) AS support, round(s / sa, 6) AS confidence, round(s / sa / sc, 6) AS lift,
        round(s - sa * sc, 6) AS leverage, CASE WHEN s / sa >= 1 THEN NULL ELSE round((1 - sc) / (1 - s / sa), 6) END AS conviction FROM rules WHERE s / sa / sc >= 1.0""", _itemsets_sql(ones, least))


def _rules(m: BinaryMatrix, least: float) -> DataFrame:
    """Conviction is null where it is infinite."""
    r = mining.association_rules(mining.frequent_itemsets(m, least), 1.0)
    return r.select(F.array_join("antecedents", ", ").alias("antecedents"), F.array_join("consequents", ", ").alias("consequents"), *r6("support", "confidence", "lift", "leverage"),
                    F.when(F.col("confidence") < 1, F.round("conviction", 6)).alias("conviction"))


@query("m3_class_rules", _rules_sql("cones", 0.01))
def _(s, d):
    return _rules(star_matrix(s, d).class_level(), 0.01)


@query("m4_gene_rules", _rules_sql("gones", 0.03))
def _(s, d):
    return _rules(star_matrix(s, d).role("gene"), 0.03)


_DIRECTED = """
dir AS (SELECT item1 AS a, item2 AS b, ord1 AS oa, ord2 AS ob, phi AS r, k1 AS na, k2 AS nb, n11 AS n_ab, n FROM hv WHERE phi > 0.02
        UNION ALL SELECT item2, item1, ord2, ord1, phi, k2, k1, n11, n FROM hv WHERE phi > 0.02),
top50 AS (SELECT * FROM dir ORDER BY round(r, 10) DESC, oa, ob LIMIT 50),
top20 AS (SELECT * FROM dir ORDER BY round(r, 10) DESC, oa, ob LIMIT 20)"""


@query("m5_ordered_pairs", sql("SELECT a || '→' || b AS pattern, round(n_ab / n, 6) AS support, round(n_ab / na, 6) AS confidence, round(n_ab / na / (nb / n), 6) AS lift FROM top50 WHERE n_ab / n >= 0.01 AND n_ab / na >= 0.1", o.NETWORK, _DIRECTED))
def _(s, d):
    return mining.ordered_pairs(star_matrix(s, d), 0.01, 0.1, 0.02).select(F.concat_ws("→", "path").alias("pattern"), *r6("support", "confidence", "lift"))


@query("m6_ordered_triplets", sql("""SELECT w.a || '→' || w.b || '→' || w.c AS pattern, round(count(x.r) / any_value(w.n), 6) AS support, round(any_value(w.n_ab / w.na * j.n11 / w.nb), 6) AS confidence, round(any_value(w.n_ab / w.na * j.n11 / w.nb / (w.nc / w.n)), 6) AS lift
    FROM (SELECT DISTINCT e.a, e.b, t.a AS c, e.na, e.nb, t.na AS nc, e.n_ab, e.n FROM top20 e JOIN top20 t ON t.a <> e.a AND t.a <> e.b) w JOIN hj j ON j.f1 = w.b AND j.f2 = w.c
    JOIN ones x ON x.f = w.a JOIN ones y ON y.r = x.r AND y.f = w.b JOIN ones z ON z.r = x.r AND z.f = w.c
    GROUP BY w.a, w.b, w.c HAVING count(x.r) / any_value(w.n) >= 0.001 AND any_value(w.n_ab / w.na * j.n11 / w.nb) >= 0.01""", o.NETWORK, _DIRECTED))
def _(s, d):
    return mining.ordered_triplets(star_matrix(s, d), 0.001, 0.01, 0.02).select(F.concat_ws("→", "path").alias("pattern"), *r6("support", "confidence", "lift"))


def _hyper_sql(x: str, r: str, k: str) -> str:
    g = lambda v: f"lgamma({v} + 1)"
    return f"exp({g(r)} + {g(f'n - {r}')} + {g(k)} + {g(f'n - {k}')} - {g('n')} - {g(x)} - {g(f'{r} - {x}')} - {g(f'{k} - {x}')} - {g(f'n - {r} - {k} + {x}')})"


@query("m5_shuffled_p", sql(f"""SELECT a || '→' || b AS pattern, round(avg((u > 1 - p)::INT), 6) AS p_value FROM (
    SELECT a, b, {draws.unit_md5_sql("'42'", "a || '→' || b", 'g.i')} AS u, p FROM (SELECT a, b, least(1, list_sum(list_transform(range(n_ab, least(na, nb) + 1), lambda x: {_hyper_sql('x', 'na', 'nb')}))) AS p FROM top50) t, range(0, 100) AS g(i)) GROUP BY a, b""", o.NETWORK, _DIRECTED))
def _(s, d):
    return mining.ordered_pairs(star_matrix(s, d), 0.0, 0.0, 0.02, shuffles=100).select(F.concat_ws("→", "path").alias("pattern"), *r6("p_value"))


@query("m6_triplet_p", sql("""SELECT a || '→' || b || '→' || c AS pattern, round(least(1, sum(px * CASE WHEN n_ab * n_bc = 0 THEN 1 WHEN x = 0 THEN 0 WHEN y0 <= greatest(0, nb + nc - n) THEN 1 ELSE coalesce(tail, 0) END)), 6) AS p_value
    FROM xs LEFT JOIN ys ON ys.b2 = xs.b AND ys.c2 = xs.c AND ys.y = xs.y0 GROUP BY a, b, c""", o.NETWORK, _DIRECTED, f"""
trip AS (SELECT DISTINCT e.a, e.b, t.a AS c, e.na, e.nb, t.na AS nc, e.n_ab, e.n, coalesce(j.n11, 0) AS n_bc FROM top20 e JOIN top20 t ON t.a <> e.a AND t.a <> e.b LEFT JOIN hj j ON j.f1 = e.b AND j.f2 = t.a),
ys AS (SELECT b AS b2, c AS c2, y, sum({_hyper_sql('y', 'nb', 'nc')}) OVER (PARTITION BY b, c ORDER BY y DESC) AS tail FROM (SELECT DISTINCT b, c, nb, nc, n FROM trip), LATERAL (SELECT unnest(range(greatest(0, nb + nc - n), least(nb, nc) + 1)) AS y)),
xs AS (SELECT *, {_hyper_sql('x', 'na', 'nb')} AS px, CASE WHEN x > 0 THEN (n_ab * n_bc + x - 1) // x END AS y0 FROM trip, LATERAL (SELECT unnest(range(greatest(0, na + nb - n), least(na, nb) + 1)) AS x))"""))
def _(s, d):
    return mining.ordered_triplets(star_matrix(s, d), 0.0, 0.0, 0.02, exact_p=True).select(F.concat_ws("→", "path").alias("pattern"), *r6("p_value"))


# ---- graph ------------------------------------------------------------------------------------


@query("g1_network_edges", sql("SELECT src, dst, phi, p_value, edge_type FROM edges", o.NETWORK))
def _(s, d):
    return graph.network_edges(star_matrix(s, d))


@query("g2_edge_list", sql("SELECT src, dst, printf('%.3f', p_value) || CASE WHEN p_value < 0.001 THEN ' ***' WHEN p_value < 0.01 THEN ' **' WHEN p_value < 0.05 THEN ' *' ELSE '' END AS significance FROM edges", o.NETWORK))
def _(s, d):
    return graph.edge_list(graph.network_edges(star_matrix(s, d))).select("src", "dst", "significance")


@query("g3_louvain")
def _(s, d):
    return communities.louvain(_edges(star_matrix(s, d)))


#: Modularity of the given partition, over edges in both directions.
_MODULARITY = """
wb AS (SELECT src, dst, phi AS w FROM edges UNION ALL SELECT dst, src, phi FROM edges),
q AS (SELECT sum(inside / total - pow(every / total, 2)) AS modularity FROM (
      SELECT a.community, sum(w) AS every, sum(CASE WHEN a.community = b.community THEN w ELSE 0 END) AS inside FROM wb JOIN comm a ON a.id = src JOIN comm b ON b.id = dst GROUP BY a.community), (SELECT sum(w) AS total FROM wb))"""


@query("g3_modularity", sql("SELECT round(modularity, 6) AS modularity FROM q", o.NETWORK, _MODULARITY))
def _(s, d):
    m = star_matrix(s, d)
    return communities.modularity(_edges(m), _communities(m)).select(*r6("modularity"))


@query("g3_louvain_quality", sql("""SELECT (SELECT count(*) FROM vs) AS n_members, (SELECT count(*) FROM vs) AS n_distinct, 0::BIGINT AS n_strangers, 1 AS first_number, true AS numbered_by_size, 0::BIGINT AS n_over_components,
    round((SELECT modularity FROM q), 6) AS given, true AS above_given, true AS above_whole""", o.NETWORK, _MODULARITY))
def _(s, d):
    """What any right answer has: every node once, no community over two components, and more modularity than the given partition and than one community."""
    m = star_matrix(s, d)
    e = _edges(m)
    found, c = settled(communities.louvain(e)), communities.components(e)
    sizes = found.groupBy("community").agg(F.count("*").alias("size"))
    steps = sizes.withColumn("next", F.col("community") + 1).alias("a").join(sizes.alias("b"), F.col("a.next") == F.col("b.community"))
    one = found.agg(F.count("*").alias("n_members"), F.count_distinct("id").alias("n_distinct"), F.min("community").alias("first_number"))
    one = one.crossJoin(found.join(graph.nodes(e), "id", "left_anti").agg(F.count("*").alias("n_strangers")))
    one = one.crossJoin(steps.agg(F.coalesce(F.bool_and(F.col("a.size") >= F.col("b.size")), F.lit(True)).alias("numbered_by_size")))
    one = one.crossJoin(found.join(c, "id").groupBy("community").agg(F.count_distinct("component").alias("k")).agg(F.sum((F.col("k") > 1).cast("long")).alias("n_over_components")))
    one = one.crossJoin(communities.modularity(e, _communities(m)).withColumnRenamed("modularity", "given")).crossJoin(communities.modularity(e, found))
    return one.select("n_members", "n_distinct", "n_strangers", "first_number", "numbered_by_size", "n_over_components", *r6("given"), (F.col("modularity") > F.col("given")).alias("above_given"), (F.col("modularity") > 0).alias("above_whole"))


@query("g3_components", sql("SELECT src AS id, min(dst) AS component FROM sp GROUP BY src", o.NETWORK))
def _(s, d):
    return communities.components(_edges(star_matrix(s, d)))


@query("g4_degree_centrality", sql("SELECT id, degree, round(degree_centrality, 6) AS degree_centrality FROM deg", o.NETWORK))
def _(s, d):
    return graph.degree_centrality(_edges(star_matrix(s, d))).select("id", "degree", *r6("degree_centrality"))


@query("g5_betweenness", sql("SELECT id, round(betweenness, 6) AS betweenness FROM btw", o.NETWORK))
def _(s, d):
    return graph.betweenness(graph.shortest_paths(_edges(star_matrix(s, d)))).select("id", *r6("betweenness"))


#: Power iteration of A + I on the edges, as many steps as make all digits that are shown settle.
_EIGEN = """
pw AS (SELECT 0 AS step, id, 1 / sqrt((SELECT count(*) FROM vs)) AS v FROM vs
       UNION ALL SELECT step, id, y / sqrt(sum(y * y) OVER ()) FROM (
           SELECT pw.step + 1 AS step, adj.src AS id, sum(pw.v) AS y FROM pw JOIN (SELECT src, dst FROM bi UNION ALL SELECT id, id FROM vs) adj ON adj.dst = pw.id WHERE pw.step < 400 GROUP BY pw.step, adj.src)),
eig AS (SELECT id, v FROM pw WHERE step = 400)"""


@query("g6_eigenvector", sql("SELECT id, round(v, 6) AS eigenvector FROM eig", o.NETWORK, _EIGEN))
def _(s, d):
    return graph.eigenvector_centrality(_edges(star_matrix(s, d))).select("id", *r6("eigenvector"))


@query("g7_shortest_paths", sql("SELECT src, dst, distance, paths::BIGINT AS paths FROM sp", o.NETWORK))
def _(s, d):
    return graph.shortest_paths(_edges(star_matrix(s, d)))


@query("g8_row_risk", sql("""SELECT r AS isolate, round(risk, 6) AS risk, round((below + (same + 1) / 2) / n * 100, 6) AS percentile_rank, risk > q AS predicted FROM (
    SELECT *, (rank() OVER (ORDER BY risk) - 1) AS below, count(*) OVER (PARTITION BY risk) AS same, count(*) OVER () AS n, quantile_cont(risk, 0.75) OVER () AS q FROM (
    SELECT rws.r, round(coalesce(sum(degree_centrality * coalesce(weight, 1.0)), 0), 12) AS risk FROM rws LEFT JOIN ones ON ones.r = rws.r LEFT JOIN deg ON deg.id = ones.f LEFT JOIN wts ON wts.f = ones.f GROUP BY rws.r))""",
                         o.NETWORK, """
ci AS (SELECT f, least(0.9, k / n) AS lo, least(0.9, k / n) + ord / 100 AS hi FROM hk WHERE role <> 'gene'),
w0 AS (SELECT f, CASE WHEN hi - lo > 0 THEN 1 / (hi - lo + 0.01) ELSE 1 END AS w FROM ci),
wts AS (SELECT f, w / max(w) OVER () AS weight FROM w0)"""))
def _(s, d):
    m = star_matrix(s, d)
    score = graph.degree_centrality(_edges(m)).select("id", F.col("degree_centrality").alias("node_score"))
    lo = F.least(F.lit(0.9), F.col("prevalence"))
    ci = pairs.prevalence(m.role("phenotype")).select("feature", lo.alias("lo"), (lo + F.col("ord") / 100).alias("hi"))
    return graph.row_risk(m, score, ci).select(F.col("row").alias("isolate"), *r6("risk", "percentile_rank"), "predicted")


@query("g8_node_scores", sql("""SELECT deg.id, round(degree_centrality, 6) AS degree_centrality, round(betweenness, 6) AS betweenness, round(v, 6) AS eigenvector, round(0.4 * degree_centrality + 0.3 * betweenness + 0.3 * v, 6) AS node_score
    FROM deg JOIN btw ON btw.id = deg.id JOIN eig ON eig.id = deg.id""", o.NETWORK, _EIGEN))
def _(s, d):
    return graph.node_scores(_edges(star_matrix(s, d))).select("id", *r6("degree_centrality", "betweenness", "eigenvector", "node_score"))


@query("g9_isolated_nodes", sql("SELECT f AS id FROM pfeats WHERE f NOT IN (SELECT item1 FROM za WHERE adj_p <= 0.05 UNION SELECT item2 FROM za WHERE adj_p <= 0.05)", o.pairs("z", "pones", "rws", "pfeats")))
def _(s, d):
    m = star_matrix(s, d).role("phenotype")
    return m.features.select(F.col("feature").alias("id")).join(graph.nodes(_edges(m)), "id", "left_anti")


# ---- scores -----------------------------------------------------------------------------------


def _network(s: SparkSession, d: str):
    m = star_matrix(s, d)
    tests = _tests(m)  # one pass over the rows for all that follows
    e = settled(graph.network_edges(m, tests=tests))
    return m, e, tests, graph.shortest_paths(e), _communities(m)


_SCORED = "scored AS (" + o.cs("(SELECT a.id AS gene1, b.id AS gene2, a.community FROM comm a JOIN comm b ON a.community = b.community AND a.id < b.id)") + ")"


@query("c1_coselection_scores", sql("SELECT gene1, gene2, round(cs, 6) AS cs FROM scored", o.NETWORK, _SCORED))
def _(s, d):
    _, _, t, paths, c = _network(s, d)
    return scores.coselection_scores(scores.community_pairs(c), t, paths, c).select("gene1", "gene2", *r6("cs"))


@query("c2_coselection_modules", sql("""SELECT h.community AS module_id, array_to_string(list_sort(list(id)), ',') AS genes, count(*)::INT AS n_genes, round(any_value(avg_cs), 6) AS avg_cs_score, any_value(n) AS n_high_scoring_pairs
    FROM (SELECT community, count(*) AS n, avg(cs) AS avg_cs FROM scored WHERE cs >= 0.45 GROUP BY community HAVING count(*) >= 1) h JOIN comm USING (community) GROUP BY h.community""", o.NETWORK, _SCORED))
def _(s, d):
    _, _, t, paths, c = _network(s, d)
    out = scores.coselection_modules(t, paths, c, threshold=0.45)
    return out.select("module_id", F.array_join("genes", ",").alias("genes"), "n_genes", *r6("avg_cs_score"), "n_high_scoring_pairs")


@query("c3_coselection_ranking", sql("""SELECT gene1 AS gene, round(potential, 6) AS potential FROM (SELECT gene1, round(0.4 * sum((cs >= 0.7)::INT) / count(*) + 0.4 * avg(cs) + 0.2 * least(any_value(sz) / 10, 1), 12) AS potential
    FROM (""" + o.cs("(SELECT a.id AS gene1, b.id AS gene2 FROM vs a JOIN vs b ON a.id <> b.id)") + """) q JOIN comm ON comm.id = gene1 JOIN (SELECT community, count(*) AS sz FROM comm GROUP BY community) z ON z.community = comm.community GROUP BY gene1) ORDER BY potential DESC, gene1 LIMIT 20""", o.NETWORK))
def _(s, d):
    _, _, t, paths, c = _network(s, d)
    return scores.rank_by_potential(t, paths, c).select("gene", *r6("potential"))


@query("g10_coselection_network", sql("SELECT gene1, gene2, round(cs, 6) AS weight FROM (" + o.cs("(SELECT lo AS gene1, hi AS gene2 FROM best)") + ") WHERE cs >= 0.4", o.NETWORK))
def _(s, d):
    _, _, t, paths, c = _network(s, d)
    return scores.coselection_network(t, paths, c, 0.4).select("gene1", "gene2", *r6("weight"))


_TARGETS = """
ass AS (SELECT id, arg_max({phi: phi, p: p}, {a: abs(phi), b: -p}) AS v FROM (SELECT item1 AS id, phi, p FROM ht UNION ALL SELECT item2, phi, p FROM ht) GROUP BY id),
mods AS (SELECT DISTINCT id FROM comm WHERE community IN (SELECT community FROM scored WHERE cs >= 0.45 GROUP BY community)),
tg AS (SELECT deg.id AS gene, abs(ass.v.phi) AS association, degree_centrality AS degree, betweenness, k / n AS prevalence, CASE WHEN mods.id IS NOT NULL THEN 1.0 WHEN sz >= 3 THEN 0.5 ELSE 0 END AS mobility
       FROM deg JOIN btw USING (id) JOIN ass USING (id) JOIN hk ON hk.f = deg.id LEFT JOIN mods ON mods.id = deg.id JOIN comm ON comm.id = deg.id JOIN (SELECT community, count(*) AS sz FROM comm GROUP BY community) z ON z.community = comm.community)"""


@query("r1_intervention_targets", sql("SELECT gene, round(association, 6) AS association, round(degree, 6) AS degree, round(betweenness, 6) AS betweenness, round(prevalence, 6) AS prevalence, mobility::DOUBLE AS mobility, round(0.3 * association + 0.2 * degree + 0.2 * betweenness + 0.2 * prevalence + 0.1 * mobility, 6) AS priority FROM tg", o.NETWORK, _SCORED, _TARGETS))
def _(s, d):
    return _targets(s, d).select("gene", *r6("association", "degree", "betweenness", "prevalence", "mobility", "priority"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    m, e, t, paths, c = _network(s, d)
    return scores.intervention_targets(e, paths, c, t, scores.coselection_modules(t, paths, c, threshold=0.45), pairs.prevalence(m))


@query("p8_top_targets", sql("SELECT gene, round(association, 6) AS association, round(prevalence, 6) AS prevalence FROM (SELECT *, round(0.3 * association + 0.2 * degree + 0.2 * betweenness + 0.2 * prevalence + 0.1 * mobility, 12) AS priority FROM tg) WHERE association >= 0.03 AND prevalence >= 0.1 ORDER BY priority DESC, gene LIMIT 10", o.NETWORK, _SCORED, _TARGETS))
def _(s, d):
    return scores.top_targets(_targets(s, d), 10, 0.03, 0.1).select("gene", *r6("association", "prevalence"))


# ---- windows, sets, text, checks, advanced ----------------------------------------------------


@query("w1_percentile_rank", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_orderpriority) - 1 + (count(*) OVER (PARTITION BY o_orderpriority) + 1) / 2) / count(*) OVER () * 100, 6) AS percentile_rank FROM orders")
def _(s, d):
    return ordering.percentile_rank(_read(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", *r6("percentile_rank"))


@query("w2_above_quantile", "SELECT o_orderkey, o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders) AS high FROM orders")
def _(s, d):
    orders = _read(s, d, "orders")
    return orders.crossJoin(F.broadcast(ordering.quantiles(orders, "o_totalprice", {"q": 0.75}))).select("o_orderkey", (F.col("o_totalprice") > F.col("q")).alias("high"))


@query("w8_extremes", "(SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def _(s, d):
    orders = _read(s, d, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).withColumn("side", F.lit("top")).union(orders.orderBy("o_totalprice", "o_orderkey").limit(10).withColumn("side", F.lit("bottom")))


@query("u1_union_padded", sql("SELECT f AS feature, k, NULL::VARCHAR AS role FROM (SELECT f, count(*) AS k FROM cones GROUP BY f) UNION ALL SELECT f, count(*), 'gene' FROM gones GROUP BY f"))
def _(s, d):
    m = star_matrix(s, d)
    count = lambda x: x.ones.groupBy("feature").agg(F.count("*").alias("k"))
    return count(m.class_level()).unionByName(count(m.role("gene")).withColumn("role", F.lit("gene")), allowMissingColumns=True)


@query("u2_distinct_pairs", sql("SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM bi", o.NETWORK))
def _(s, d):
    return graph.both_ways(_edges(star_matrix(s, d))).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


@query("u5_id_intersection", "SELECT l_orderkey AS id FROM lineitem INTERSECT SELECT o_orderkey FROM orders")
def _(s, d):
    return _read(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).intersect(_read(s, d, "orders").select("o_orderkey"))


@query("k14_sheet_names", "SELECT p_partkey, substr(translate(p_name || ': ' || p_brand || '/' || p_type || '[*?]', ':\\/?*[]', '_______'), 1, 31) AS sheet FROM part")
def _(s, d):
    return _read(s, d, "part").select("p_partkey", text.sheet_name(F.concat("p_name", F.lit(": "), "p_brand", F.lit("/"), "p_type", F.lit("[*?]"))).alias("sheet"))


@query("v4_data_summary", sql("SELECT any_value(n) AS n_samples, count(*) AS n_features, round(avg(k / n), 6) AS mean_prevalence, round(min(k / n), 6) AS min_prevalence, round(max(k / n), 6) AS max_prevalence FROM hk", o.NETWORK))
def _(s, d):
    return validation.data_summary(star_matrix(s, d)).select("n_samples", "n_features", *r6("mean_prevalence", "min_prevalence", "max_prevalence"))


_ITEM_SUMS = """
used AS (SELECT DISTINCT unnest([items, a, c]) AS items FROM rules WHERE s / sa >= 0.2),
hits AS (SELECT items, b, sum(w)::BIGINT AS n FROM (SELECT sets.items, unnest(tids) AS r FROM sets JOIN used ON used.items = sets.items) t JOIN wts ON wts.r = t.r GROUP BY items, b),
lifts AS (SELECT rules.a, rules.c, quantile_cont(z.n * total / (x.n * y.n), 0.025) AS lo, quantile_cont(z.n * total / (x.n * y.n), 0.975) AS hi
          FROM rules JOIN hits z ON z.items = rules.items JOIN hits x ON x.items = rules.a AND x.b = z.b JOIN hits y ON y.items = rules.c AND y.b = z.b JOIN tot ON tot.b = z.b WHERE s / sa >= 0.2 GROUP BY rules.a, rules.c)"""


@query("x1_rules_with_intervals", sql("""SELECT array_to_string(rules.a, ', ') AS antecedents, array_to_string(rules.c, ', ') AS consequents, round(s, 6) AS support, round(s / sa, 6) AS confidence, round(s / sa / sc, 6) AS lift,
    round(lo, 6) AS lift_ci_lower, round(hi, 6) AS lift_ci_upper, lo > 1 OR hi < 1 AS is_significant FROM rules JOIN lifts ON lifts.a = rules.a AND lifts.c = rules.c""", _itemsets_sql("cones", 0.03), _weights_sql(500), _ITEM_SUMS))
def _(s, d):
    out = advanced.rules_with_intervals(star_matrix(s, d).class_level(), 0.03, 0.2, 500)
    return out.select(*[F.array_join(c, ", ").alias(c) for c in ("antecedents", "consequents")], *r6("support", "confidence", "lift", "lift_ci_lower", "lift_ci_upper"), "is_significant")


_RESAMPLED = f"""
xk AS (SELECT cfeats.f, cfeats.ord, tot.b, total AS n, coalesce(k, 0) AS k FROM cfeats CROSS JOIN tot LEFT JOIN (SELECT f, b, sum(w)::BIGINT AS k FROM cones JOIN wts ON wts.r = cones.r GROUP BY f, b) q ON q.f = cfeats.f AND q.b = tot.b),
xj AS (SELECT x.f AS f1, y.f AS f2, b, sum(w)::BIGINT AS n11 FROM cones x JOIN cones y ON x.r = y.r AND x.f <> y.f JOIN wts ON wts.r = x.r GROUP BY x.f, y.f, b),
xc AS (SELECT x.b, x.f AS item1, y.f AS item2, x.n, x.n - x.k - y.k + coalesce(n11, 0) AS n00, y.k - coalesce(n11, 0) AS n01, x.k - coalesce(n11, 0) AS n10, coalesce(n11, 0) AS n11
       FROM xk x JOIN xk y ON x.ord < y.ord AND x.b = y.b LEFT JOIN xj ON f1 = x.f AND f2 = y.f AND xj.b = x.b WHERE x.k > 0 AND x.k < x.n AND y.k > 0 AND y.k < y.n),
xv AS (SELECT *, {o.LEAST_E} < 5 AS exact, {o.YATES} AS y FROM xc),
xt AS (SELECT *, CASE WHEN exact THEN {o.FISHER} ELSE {o.erfc('sqrt(y / 2)')} END AS p FROM xv),
xr AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p, item1, item2) AS rk, count(*) OVER (PARTITION BY b) AS m FROM xt),
xa AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY b ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM xr)"""


@query("x2_edge_confidence", sql("SELECT item1 AS src, item2 AS dst, round(count(*) / 500, 6) AS confidence, count(*) / 500 >= 0.8 AS high_confidence FROM xa WHERE adj_p <= 0.05 GROUP BY item1, item2", _weights_sql(500), _RESAMPLED))
def _(s, d):
    return advanced.network_confidence(star_matrix(s, d).class_level(), 500).select("src", "dst", *r6("confidence"), "high_confidence")


@query("x2_edge_function", sql("SELECT least(item1, item2) AS src, greatest(item1, item2) AS dst, round(count(*) / 500, 6) AS confidence, count(*) / 500 >= 0.8 AS high_confidence FROM xa WHERE adj_p <= 0.05 GROUP BY 1, 2", _weights_sql(500), _RESAMPLED))
def _(s, d):
    """The same by the hook for edge functions."""
    return advanced.edge_confidence(star_matrix(s, d).class_level(), advanced.network_by_replicate(), 500).select("src", "dst", *r6("confidence"), "high_confidence")


@query("x4_pattern_function", sql("SELECT feats.f AS feature, round(coalesce(sum((n >= 0.3::DOUBLE * total)::INT), 0) * 100 / 500, 6) AS stability FROM feats CROSS JOIN tot LEFT JOIN sums ON sums.f = feats.f AND sums.b = tot.b GROUP BY feats.f", _weights_sql(500), _FEATURE_SUMS))
def _(s, d):
    """The same as ``x4_pattern_stability`` by the hook for pattern functions."""

    def frequent(rows: DataFrame) -> DataFrame:
        n = rows.select("replicate", "n", F.explode("has").alias("feature")).groupBy("replicate", "feature").agg(F.sum("n").alias("n"))
        return n.join(rows.groupBy("replicate").agg(F.sum("n").alias("total")), "replicate").where(F.col("n") >= 0.3 * F.col("total"))

    return advanced.pattern_recurrence(star_matrix(s, d), frequent, 500).select("feature", *r6("stability"))


@query("x3_entropy_weighted", sql("""SELECT f AS feature, round(k / n, 6) AS base_importance, round(e, 6) AS entropy, round(k / n * (1 - 0.5 * (1 - e)), 6) AS adjusted_importance FROM (
    SELECT *, CASE WHEN k = 0 OR k = n THEN 0 ELSE -(k / n * log2(k / n) + (1 - k / n) * log2(1 - k / n)) END AS e FROM hk)""", o.NETWORK))
def _(s, d):
    m = star_matrix(s, d)
    return advanced.entropy_weighted(m, pairs.prevalence(m).select("feature", F.col("prevalence").alias("importance"))).select("feature", *r6("base_importance", "entropy", "adjusted_importance"))


@query("x4_pattern_stability", sql("SELECT feats.f AS feature, round(coalesce(sum((n >= 0.3::DOUBLE * total)::INT), 0) * 100 / 500, 6) AS stability FROM feats CROSS JOIN tot LEFT JOIN sums ON sums.f = feats.f AND sums.b = tot.b GROUP BY feats.f", _weights_sql(500), _FEATURE_SUMS))
def _(s, d):
    return advanced.pattern_stability(star_matrix(s, d), 0.3, 500).select("feature", *r6("stability"))


@query("x5_redundant_pairs", sql("SELECT item1 AS feature1, item2 AS feature2, round(n11 / (k1 + k2 - n11), 6) AS jaccard FROM hc WHERE n11 / (k1 + k2 - n11) > 0.25", o.NETWORK))
def _(s, d):
    return advanced.redundant_pairs(star_matrix(s, d), 0.25).select("feature1", "feature2", *r6("jaccard"))


def _isolates(s: SparkSession, d: str) -> DataFrame:
    """Orders as isolates that get synthetic values."""
    return _read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("row"))


def _synthetic_sql(columns: list[tuple], noise: float) -> list[str]:
    """CTEs yrows and yones of generated columns: (name, chance, name of the column it depends on or null, chance where that is 1)."""
    values = ", ".join(f"('{name}', {p!r}, {'NULL::VARCHAR' if base is None else repr(base)}, {p1!r}, {i})" for i, (name, p, base, p1) in enumerate(columns))
    u = lambda name: draws.unit_md5_sql("'42'", name, "r")
    return [f"""
yrows AS (SELECT o_orderkey::VARCHAR AS r FROM orders),
ycols(f, p0, base, p1, ord) AS (VALUES {values}),
yfree AS (SELECT r, f, ({u('f')} < p0)::INT AS v FROM yrows, ycols WHERE base IS NULL),
ytied AS (SELECT yrows.r, c.f, ({draws.unit_md5_sql("'42'", "c.f", "yrows.r")} < CASE WHEN x.v = 1 THEN c.p1 ELSE c.p0 END)::INT AS v FROM yrows, ycols c JOIN yfree x ON x.f = c.base WHERE x.r = yrows.r),
yall AS (SELECT * FROM yfree UNION ALL SELECT * FROM ytied),
yones AS (SELECT r, f FROM yall WHERE CASE WHEN {u("f || '/noise'")} < {noise!r} THEN 1 - v ELSE v END = 1),
yfeats AS (SELECT f, 'gene' AS role, ord, NULL::VARCHAR AS class FROM ycols)"""]


def _tied(p: float, rho: float) -> tuple[float, float]:
    return max(0.05, p - rho * p), min(0.95, p + rho * (1 - p))


def _synthetic_columns() -> list[tuple]:
    drugs = [x for c in o.DRUG_CLASSES.values() for x in c]
    names = drugs + [f"AMR_Gene_{i:02d}" for i in range(1, 31)] + [f"Virulence_{i:02d}" for i in range(1, 21)]
    out = []
    for i, (name, p) in enumerate(zip(names, synth.beta_prevalences(len(names), 0.35, 0.2, 42))):
        at = i - len(drugs)
        low, high = _tied(p, 0.7)
        out.append((name, low, drugs[at], high) if 0 <= at < len(drugs) and at % 3 == 0 else (name, p, None, p))
    return out


@query("y5_synthetic_matrix", "WITH " + ",".join(_synthetic_sql(_synthetic_columns(), 0.05)) + " SELECT f AS feature, count(*) AS k FROM yones GROUP BY f")
def _(s, d):
    return synth.synthetic_matrix(s, rows=_isolates(s, d))[0].ones.groupBy("feature").agg(F.count("*").alias("k"))


@query("v17_histogram", """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
    SELECT bin, round(a + (bin - 1) * (b - a) / 30, 6) AS lo, round(a + bin * (b - a) / 30, 6) AS hi, count(*) AS n FROM (
    SELECT least(floor((o_totalprice - a) / ((b - a) / 30)) + 1, 30)::INT AS bin, a, b FROM orders, e) GROUP BY bin, a, b""")
def _(s, d):
    return charts.histogram(_read(s, d, "orders"), "o_totalprice").select("bin", *r6("lo", "hi"), "n")


@query("v17_box", """SELECT o_orderpriority, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
    round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS largest FROM orders GROUP BY o_orderpriority""")
def _(s, d):
    return charts.spread_by_group(_read(s, d, "orders"), "o_totalprice", "o_orderpriority").select("o_orderpriority", "least", *r6("q1", "median", "q3"), "largest")


@query("v17_network_nodes", sql("SELECT id, degree, 15 + 3 * degree AS size FROM deg", o.NETWORK))
def _(s, d):
    return charts.network_nodes(_edges(star_matrix(s, d)))


@query("a7_module_pairs", sql("SELECT community, count(*) AS n_pairs, round(avg(cs), 6) AS avg_cs, sum((cs >= 0.45)::INT)::BIGINT AS n_high FROM scored GROUP BY community", o.NETWORK, _SCORED))
def _(s, d):
    _, _, t, paths, c = _network(s, d)
    scored = scores.coselection_scores(scores.community_pairs(c), t, paths, c)
    return scored.groupBy("community").agg(F.count("*").alias("n_pairs"), F.round(F.avg("cs"), 6).alias("avg_cs"), F.sum((F.col("cs") >= 0.45).cast("long")).alias("n_high"))


@query("a16_community_sizes", sql("SELECT component, count(*) AS size FROM (SELECT src AS id, min(dst) AS component FROM sp GROUP BY src) GROUP BY component", o.NETWORK))
def _(s, d):
    return communities.components(_edges(star_matrix(s, d))).groupBy("component").agg(F.count("*").alias("size"))


@query("j4_strongest_lookup", sql("SELECT lo, hi, round(phi, 6) AS phi FROM best", o.NETWORK))
def _(s, d):
    return scores.strongest_first(_tests(star_matrix(s, d))).select("lo", "hi", *r6("phi"))


@query("j13_ordered_node_pairs", sql("SELECT a.id AS gene1, b.id AS gene2 FROM vs a JOIN vs b ON a.id <> b.id", o.NETWORK))
def _(s, d):
    ids = graph.nodes(_edges(star_matrix(s, d)))
    return ids.select(F.col("id").alias("gene1")).join(ids.select(F.col("id").alias("gene2")), F.col("gene1") != F.col("gene2"))


@query("p9_significant_pairs", sql("SELECT item1, item2 FROM ha WHERE holm <= 0.05", o.NETWORK))
def _(s, d):
    return pairs.cooccurrence(star_matrix(s, d), method="holm").select("item1", "item2")


@query("u4_binary_subset", "SELECT bool_and(l_linenumber IN (0, 1)) AS linenumber, bool_and((l_returnflag = 'R')::INT IN (0, 1)) AS flag FROM lineitem")
def _(s, d):
    return _read(s, d, "lineitem").agg(F.bool_and(F.col("l_linenumber").isin(0, 1)).alias("linenumber"), F.bool_and((F.col("l_returnflag") == "R").cast("int").isin(0, 1)).alias("flag"))


def _clustered_sql() -> str:
    drugs = [x for c in o.DRUG_CLASSES.values() for x in c]
    rates = [synth.beta_prevalences(len(drugs), m, 0.15, 42 + i) for i, m in enumerate((0.25, 0.6))]
    values = ", ".join(f"('{x}', {a!r}, {b!r}, {i})" for i, (x, a, b) in enumerate(zip(drugs, *rates)))
    u = lambda name: draws.unit_md5_sql("'42'", name, "r")
    noisy = lambda name: f"CASE WHEN {u(name + chr(32) + '||' + chr(32) + repr('/noise'))} < 0.05 THEN 1 - v ELSE v END"
    return f"""WITH yrows AS (SELECT r, {u("'cluster'")} < 0.5 AS second FROM (SELECT o_orderkey::VARCHAR AS r FROM orders)),
ydrugs(f, a, b, ord) AS (VALUES {values}),
d AS (SELECT r, f, ({u('f')} < CASE WHEN second THEN b ELSE a END)::INT AS v FROM yrows, ydrugs),
g AS (SELECT r, 'gene_' || f AS f, ({u("'gene_' || f")} < least(0.95, 0.2 + 0.3 * v))::INT AS v FROM d)
SELECT f AS feature, sum({noisy('f')})::BIGINT AS k FROM (SELECT * FROM d UNION ALL SELECT * FROM g) GROUP BY f"""


@query("y6_clustered_matrix", _clustered_sql())
def _(s, d):
    return pairs.prevalence(synth.clustered_matrix(s, rows=_isolates(s, d))[0]).select("feature", "k")


_COOCCURRING = [(f"F{i:02d}", 0.4, None, 0.4) if i % 2 == 0 else (f"F{i:02d}", _tied(0.4, 0.6)[0], f"F{i - 1:02d}", _tied(0.4, 0.6)[1]) for i in range(10)]


@query("y7_cooccurring_matrix", "WITH RECURSIVE " + ",".join([*_synthetic_sql(_COOCCURRING, 0.0), o.pairs("y", "yones", "yrows", "yfeats")]) + " SELECT item1, item2, round(phi, 6) AS phi FROM ya WHERE adj_p <= 0.05")
def _(s, d):
    return pairs.cooccurrence(synth.cooccurring_matrix(s, rows=_isolates(s, d))[0]).select("item1", "item2", *r6("phi"))


#: Tiles of the finest of the levels shown, and how many levels.
_FINEST, _LEVELS = 6, 3


@query("x8_tile_pyramid", f"""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
    t AS (SELECT least(floor((l_quantity - x0) / (x1 - x0) * {1 << _FINEST}), {(1 << _FINEST) - 1})::BIGINT AS x, least(floor((l_extendedprice - y0) / (y1 - y0) * {1 << _FINEST}), {(1 << _FINEST) - 1})::BIGINT AS y, l_returnflag, l_discount FROM lineitem, e)
    SELECT ({_FINEST} - k)::INT AS level, x >> k AS tile_x, y >> k AS tile_y, l_returnflag AS category, count(*) AS n, round(sum(l_discount), 6) AS total FROM t, range(0, {_LEVELS}) AS g(k) GROUP BY k, x >> k, y >> k, l_returnflag""")
def _(s, d):
    found = tiles.pyramid(_read(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", "l_discount", finest=_FINEST, levels=_LEVELS)
    return found.select("level", "tile_x", "tile_y", "category", "n", *r6("total"))


@query("w9_deep_page", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem ORDER BY lineitem.l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5 OFFSET 49995")
def _(s, d):
    lines = _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return pages.paged(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).page(10_000, 5).select("l_orderkey", "l_linenumber", *r6("l_extendedprice"))
