"""Checks and summaries of input tables, each in one pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.matrix import BinaryMatrix
from . import pairs


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing_share, mean, std (population), n_positive, n_negative, is_constant, is_binary."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])))
    x = F.col("x")
    return cells.groupBy("column").agg(
        F.count("*").alias("n"), F.avg(x.isNull().cast("double")).alias("missing_share"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.sum(F.coalesce((x > 0).cast("long"), F.lit(0))).alias("n_positive"), F.sum(F.coalesce((x == 0).cast("long"), F.lit(0))).alias("n_negative"),
        F.coalesce(F.min("x") == F.max("x"), F.lit(True)).alias("is_constant"), F.coalesce(F.bool_and(x.isin(0.0, 1.0)), F.lit(True)).alias("is_binary"))


def validate_input(df: DataFrame, id_col: str = "Strain_ID", feature_cols: list[str] | None = None, max_missing: float = 0.2, require_binary: bool = True) -> tuple[bool, list[str]]:
    """(valid, messages); errors make it invalid, warnings don't.  An empty table is invalid."""
    if id_col not in df.columns:
        return False, [f"error: no column {id_col}"]
    names = feature_cols or [c for c in df.columns if c != id_col]
    lost = [c for c in names if c not in df.columns]
    if lost:
        return False, [f"error: no columns {', '.join(lost)}"]
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        aggs.append(F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}"))
    for i, c in enumerate(numeric):
        v = F.col(f"`{c}`").cast("double")
        aggs += [F.coalesce(F.bool_or((v > 0) & (v < 1)), F.lit(False)).alias(f"f{i}"), F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(True)).alias(f"b{i}")]
    one = df.agg(*aggs).first()
    if not one["n"]:
        return False, ["error: no rows"]
    out = []
    repeated = duplicate_ids(df, id_col).count()
    if repeated:
        out.append(f"error: {repeated} repeated ids in {id_col}")
    out += [f"error: {c} has fractions" for i, c in enumerate(numeric) if one[f"f{i}"]]
    out += [f"warning: {c} lacks {one[f'm{i}'] / one['n']:.1%}" for i, c in enumerate(names) if one[f"m{i}"] > max_missing * one["n"]]
    if require_binary:
        out += [f"warning: {c} isn't binary" for i, c in enumerate(numeric) if not one[f"b{i}"] and not one[f"f{i}"]]
    return not any(x.startswith("error") for x in out), out


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that are given twice or more: id, times."""
    return df.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count("*").alias("times")).where("times > 1")


def data_summary(m: BinaryMatrix) -> DataFrame:
    """One row: n_samples, n_features, mean, least and largest prevalence."""
    p = pairs.prevalence(m)
    return p.agg(F.max("n").alias("n_samples"), F.count("*").alias("n_features"), F.avg("prevalence").alias("mean_prevalence"), F.min("prevalence").alias("min_prevalence"), F.max("prevalence").alias("max_prevalence"))


def overview(m: BinaryMatrix, flags: DataFrame) -> DataFrame:
    """One row: n_isolates, n_mdr, pct_mdr, n_phenotypes, n_genes."""
    f = m.features.agg(F.sum((F.col("role") == "phenotype").cast("long")).alias("n_phenotypes"), F.sum((F.col("role") == "gene").cast("long")).alias("n_genes"))
    r = flags.agg(F.count("*").alias("n_isolates"), F.sum(F.col("is_mdr").cast("long")).alias("n_mdr"))
    return r.crossJoin(f).select("n_isolates", "n_mdr", (F.col("n_mdr") * 100 / F.col("n_isolates")).alias("pct_mdr"), "n_phenotypes", "n_genes")


def validate_output(n_mdr: int, n_total: int, expected_total: int | None = None) -> list[str]:
    """Messages on an overview's numbers; none if they are consistent."""
    out = []
    if n_total <= 0:
        out.append("no isolates")
    if not 0 <= n_mdr <= max(n_total, 0):
        out.append("more multiresistant isolates than isolates")
    if expected_total is not None and n_total != expected_total:
        out.append(f"{n_total} isolates, {expected_total} expected")
    return out


def validate_synthetic(m: BinaryMatrix, expected: dict[str, float], n_rows: int, tolerance: float = 0.3) -> list[str]:
    """Messages where the shape or a prevalence is off by more than the tolerance."""
    out = []
    got = {r["feature"]: r for r in pairs.prevalence(m).collect()}  # one row for each column
    n = next(iter(got.values()))["n"] if got else 0
    if n != n_rows:
        out.append(f"{n} rows, {n_rows} expected")
    for name, p in expected.items():
        if name not in got:
            out.append(f"no column {name}")
        elif abs(got[name]["prevalence"] - p) > tolerance:
            out.append(f"{name}: prevalence {got[name]['prevalence']:.3f}, {p:.3f} expected")
    return out


def check_synthetic(df: DataFrame, expected: dict[str, float], n_rows: int, mdr: str | None = None, tolerance: float = 0.3, least: float = 0.01) -> dict:
    """passed, errors, warnings, mdr_share of a generated wide table, from one pass over it.

    Errors are a wrong number of rows or a missing column.  Warnings are values other than
    0 and 1 (null is one), and prevalences that are off by ``tolerance`` or more of what was
    expected (of ``least``, where less was).  ``mdr`` names a column of flags, whose share is
    reported; an empty table has no prevalences and no share.
    """
    names = [c for c in expected if c in df.columns]
    col = lambda c: F.col(f"`{c}`").cast("double")
    aggs = [x for i, c in enumerate(names) for x in (F.avg(col(c)).alias(f"p{i}"), F.sum((~F.coalesce(col(c).isin(0.0, 1.0), F.lit(False))).cast("long")).alias(f"b{i}"))]
    got = df.agg(F.count(F.lit(1)).alias("n"), *([F.avg(col(mdr)).alias("mdr")] if mdr else []), *aggs).first()
    errors = [] if got["n"] == n_rows else [f"{got['n']} rows, {n_rows} expected"]
    errors += [f"no column {c}" for c in expected if c not in names]
    warnings = []
    for i, c in enumerate(names):
        p, bad = got[f"p{i}"], got[f"b{i}"]
        if bad:
            warnings.append(f"{c}: {bad} values are neither 0 nor 1")
        if p is not None and abs(p - expected[c]) >= tolerance * max(expected[c], least):
            warnings.append(f"{c}: prevalence {p:.3f}, {expected[c]:.3f} expected")
    return {"passed": not errors, "errors": errors, "warnings": warnings, "mdr_share": got["mdr"] if mdr else None}
