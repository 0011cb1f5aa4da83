"""Synthetic matrices with a known truth, as seeded expressions: any number of rows, no data on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import draws
from ..sources.matrix import DRUG_CLASSES, FEATURES, BinaryMatrix


def beta_prevalences(n: int, mean: float, sd: float, seed: int = 42) -> list[float]:
    """Beta distribution of that mean and deviation (parameters of .5 at least), clipped to [.01, .99]."""
    common = max(mean * (1 - mean) / max(sd * sd, 1e-9) - 1, 0.0)
    a, b = max(mean * common, 0.5), max((1 - mean) * common, 0.5)
    return np.clip(np.random.default_rng(seed).beta(a, b, n), 0.01, 0.99).tolist()


def uniform(seed: int, name: str) -> Column:
    """A number in [0, 1) from the row's id: the same however the rows are partitioned."""
    return draws.unit_md5_column(F.lit(seed), F.lit(name), F.col("row"))


def _below(seed: int, name: str, limit: Column) -> Column:
    """``uniform`` is below the chance that the limit is the text of."""
    return draws.digits_md5_column(F.lit(seed), F.lit(name), F.col("row")) < limit


def _limit(p: float) -> Column:
    return F.lit(draws.limit_md5(p))


def bernoulli(name: str, p: float, seed: int) -> Column:
    return _below(seed, name, _limit(p)).cast("int")


def flipped(value: Column, rate: float, name: str, seed: int) -> Column:
    return F.when(_below(seed, name + "/noise", _limit(rate)), 1 - value).otherwise(value)


def _tied(p: float, rho: float) -> tuple[float, float]:
    """Chances of 1 where the base is 0 and where it is 1."""
    high, low = min(0.95, p + abs(rho) * (1 - p)), max(0.05, p - abs(rho) * p)
    return (high, low) if rho < 0 else (low, high)


def _cell(name: str, p: dict[str, float], base: str | None, rho: float) -> dict[str, str]:
    """A column by the texts that its draws are compared with; without a base both limits are the same."""
    low, high = _tied(p[name], rho) if base else (p[name], p[name])
    return {"feature": name, "base": base or "", "base_limit": draws.limit_md5(p[base]) if base else "", "low": draws.limit_md5(low), "high": draws.limit_md5(high)}


def correlated(base: Column, name: str, p: float, rho: float, seed: int) -> Column:
    """1 with p + |rho| (1 - p) where the base is 1, with p - |rho| p where it is 0 (.05 to .95); swapped for a negative rho."""
    low, high = _tied(p, rho)
    return _below(seed, name, F.when(base == 1, _limit(high)).otherwise(_limit(low))).cast("int")


def _strains(spark: SparkSession, n_rows: int) -> DataFrame:
    return spark.range(n_rows).select(F.format_string("Strain_%04d", F.col("id") + 1).alias("row"))


def synthetic_matrix(spark: SparkSession, n_rows: int = 200, n_genes: int = 30, n_virulence: int = 20, noise: float = 0.05, seed: int = 42, rows: DataFrame | None = None) -> tuple[BinaryMatrix, dict]:
    """The matrix and its truth: drugs, genes (every third of the first 13 tied to its drug) and virulence factors.

    ``rows`` (row: string) gives known isolates synthetic values, in place of ``n_rows`` new ones.
    """
    drugs = [d for c in DRUG_CLASSES.values() for d in c]
    genes = [f"AMR_Gene_{i:02d}" for i in range(1, n_genes + 1)]
    factors = [f"Virulence_{i:02d}" for i in range(1, n_virulence + 1)]
    p = dict(zip(drugs + genes + factors, beta_prevalences(len(drugs) + n_genes + n_virulence, 0.35, 0.2, seed)))
    rho = {}
    rows = _strains(spark, n_rows) if rows is None else rows.select("row")
    names = drugs + genes + factors
    bases = {g: drugs[i] for i, g in enumerate(genes[: len(drugs)]) if i % 3 == 0}
    rho |= {(d, g): 0.7 for g, d in bases.items()}
    # A row's columns are rows of one small expression: one wide one for all columns is code that isn't compiled.
    # A draw costs microseconds and a row has many, so rows are dealt out, however few files hold them.
    cells = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("row", F.inline(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in _cell(n, p, bases.get(n), 0.7).items()]) for n in names])))
    drawn = lambda name: draws.digits_md5_column(F.lit(seed), name, F.col("row"))
    limit = F.when(F.col("base") == "", F.col("low")).when(drawn(F.col("base")) < F.col("base_limit"), F.col("high")).otherwise(F.col("low"))
    flip = drawn(F.concat("feature", F.lit("/noise"))) < _limit(noise)
    of = {d: c for c, ds in DRUG_CLASSES.items() for d in ds}
    features = spark.createDataFrame([(c, "phenotype" if c in of else "gene", i, of.get(c)) for i, c in enumerate(names)], FEATURES)
    ones = cells.where((drawn(F.col("feature")) < limit) != flip).select("row", "feature")
    return BinaryMatrix(ones, rows, features), {"prevalences": p, "correlations": rho, "noise": noise, "seed": seed, "n_rows": n_rows}


def adversarial(spark: SparkSession, n_rows: int = 200) -> DataFrame:
    """Wide table of edge cases: constant, nearly constant, identical and complementary columns."""
    i = F.col("id")
    half = (i < n_rows // 2).cast("int")
    return spark.range(n_rows).select(
        F.format_string("Strain_%04d", i).alias("Strain_ID"), F.lit(0).alias("All_Zeros"), F.lit(1).alias("All_Ones"), (i == 0).cast("int").alias("Single_Positive"), (i != 0).cast("int").alias("Single_Negative"),
        half.alias("Perfect_Pos_A"), half.alias("Perfect_Pos_B"), half.alias("Perfect_Neg_A"), (1 - half).alias("Perfect_Neg_B"), (i % 2).cast("int").alias("Alternating"))


def clean_set(spark: SparkSession, n_rows: int = 200, n_features: int = 20, seed: int = 42) -> DataFrame:
    """Wide table of independent features, a perfectly correlated pair and a moderately correlated column."""
    names = [f"Feature_{i:02d}" for i in range(n_features)]
    wide = spark.range(n_rows).select(F.format_string("Strain_%04d", F.col("id")).alias("row"))
    wide = wide.withColumns({c: bernoulli(c, p, seed) for c, p in zip(names, beta_prevalences(n_features, 0.4, 0.2, seed))})
    wide = wide.withColumns({"Perfect_Corr_A": bernoulli("Perfect_Corr", 0.5, seed), "Mod_Corr_A": correlated(F.col(names[0]), "Mod_Corr_A", 0.4, 0.5, seed)})
    return wide.withColumn("Perfect_Corr_B", F.col("Perfect_Corr_A")).withColumnRenamed("row", "Strain_ID")


def noisy_set(clean: DataFrame, rate: float = 0.1, seed: int = 42, id_col: str = "Strain_ID") -> DataFrame:
    """The same table with each value of each column flipped at the rate."""
    rows = clean.withColumnRenamed(id_col, "row")
    return rows.select(F.col("row").alias(id_col), *[flipped(F.col(f"`{c}`"), rate, c, seed).alias(c) for c in clean.columns if c != id_col])


def random_tree(names: list[str], seed: int = 42) -> str:
    """A random binary tree of the names in Newick form, with branch lengths; leaves are few, so it is made at once."""
    r = np.random.default_rng(seed)
    parts = [f"{n}:{r.exponential(0.1):.4f}" for n in names]
    while len(parts) > 1:
        a, b = sorted(r.choice(len(parts), 2, replace=False).tolist())
        joined = f"({parts[a]},{parts[b]})"
        parts = [p for i, p in enumerate(parts) if i not in (a, b)] + [f"{joined}:{r.exponential(0.1):.4f}" if len(parts) > 2 else joined]
    return (parts[0] if parts else "") + ";"


def clustered_matrix(spark: SparkSession, n_rows: int = 200, bonus: float = 0.3, noise: float = 0.05, seed: int = 42, rows: DataFrame | None = None) -> tuple[BinaryMatrix, dict]:
    """Two clusters of isolates with drug rates of their own; a gene is likelier by ``bonus`` where its drug is 1.

    The truth holds each cluster's rates.  ``rows``: see ``synthetic_matrix``.
    """
    drugs = [d for c in DRUG_CLASSES.values() for d in c]
    rates = [beta_prevalences(len(drugs), m, 0.15, seed + i) for i, m in enumerate((0.25, 0.6))]
    cluster = (uniform(seed, "cluster") < 0.5).cast("int")
    rows = (_strains(spark, n_rows) if rows is None else rows.select("row")).withColumn("cluster", cluster)
    wide = rows.withColumns({d: (uniform(seed, d) < F.when(F.col("cluster") == 0, a).otherwise(b)).cast("int") for d, a, b in zip(drugs, *rates)})
    genes = {f"gene_{d}": (uniform(seed, f"gene_{d}") < F.least(F.lit(0.95), 0.2 + bonus * F.col(d))).cast("int") for d in drugs}
    wide = wide.withColumns(genes)
    names = [*drugs, *genes]
    noisy = wide.select("row", *[flipped(F.col(c), noise, c, seed).alias(c) for c in names])
    of = {d: c for c, ds in DRUG_CLASSES.items() for d in ds}
    features = spark.createDataFrame([(c, "phenotype" if c in of else "gene", i, of.get(c)) for i, c in enumerate(names)], FEATURES)
    ones = noisy.select("row", F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]))).alias("feature"))
    return BinaryMatrix(ones, rows.select("row"), features), {"rates": dict(zip(drugs, zip(*rates))), "bonus": bonus, "noise": noise}


def cooccurring_matrix(spark: SparkSession, n_rows: int = 200, n_features: int = 10, p: float = 0.4, rho: float = 0.6, seed: int = 42, rows: DataFrame | None = None) -> tuple[BinaryMatrix, list[tuple[str, str]]]:
    """Features of which every odd one is tied to the one before; the truth is the tied pairs.  ``rows``: see ``synthetic_matrix``."""
    names = [f"F{i:02d}" for i in range(n_features)]
    rows = _strains(spark, n_rows) if rows is None else rows.select("row")
    wide = rows.withColumns({n: bernoulli(n, p, seed) for n in names[::2]})
    tied = [(a, b) for a, b in zip(names[::2], names[1::2])]
    wide = wide.withColumns({b: correlated(F.col(a), b, p, rho, seed) for a, b in tied})
    features = spark.createDataFrame([(c, "gene", i, None) for i, c in enumerate(names)], FEATURES)
    ones = wide.select("row", F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]))).alias("feature"))
    return BinaryMatrix(ones, rows, features), tied


def save_synthetic(m: BinaryMatrix, truth: dict, path: str) -> None:
    """Phenotypes, genes, virulence factors and the whole as CSV folders, the truth as JSON and a note as Markdown, under ``path``."""
    import json

    from ..sources.matrix import to_wide

    spark = m.ones.sparkSession
    names = [(r["feature"], r["role"]) for r in m.features.orderBy("ord").collect()]
    kind = lambda n, role: "virulence" if n.startswith("Virulence_") else "phenotypes" if role == "phenotype" else "genes"
    parts = {p: [n for n, role in names if p in ("merged", kind(n, role))] for p in ("phenotypes", "genes", "virulence", "merged")}
    for part, cols in parts.items():
        to_wide(m, cols).withColumnRenamed("row", "Strain_ID").write.mode("overwrite").option("header", True).csv(f"{path}/{part}")
    text = json.dumps({str(k): (v if not isinstance(v, dict) else {str(a): b for a, b in v.items()}) for k, v in truth.items()})
    rows = m.rows.count()
    note = ["# Synthetic isolates", "", f"{rows} isolates.", ""] + [f"- `{p}`: {len(cols)} columns" for p, cols in parts.items()] + ["- `truth`: the rates and ties that the columns were drawn with", ""]
    for name, lines in (("truth", [text]), ("README.md", note)):
        spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("overwrite").text(f"{path}/{name}")
