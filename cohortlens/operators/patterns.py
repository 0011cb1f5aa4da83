"""Queries on a stored pattern table: filters, statistics, export, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .ordering import quantiles


def query_patterns(df: DataFrame, min_support: float | None = None, min_confidence: float | None = None, genes: list[str] | None = None, page: int | None = None, page_size: int = 100) -> DataFrame:
    """Patterns by falling support, confidence, then id; any of the genes has to occur in the list's text."""
    if min_support is not None:
        df = df.where(F.col("support") >= min_support)
    if min_confidence is not None:
        df = df.where(F.col("confidence") >= min_confidence)
    if genes:
        hit = F.lit(False)
        for g in genes:
            hit = hit | F.col("genes").contains(g)
        df = df.where(hit)
    out = df.orderBy(F.desc("support"), F.desc("confidence"), "pattern_id")
    return out if page is None else out.offset((page - 1) * page_size).limit(page_size)


def pattern_statistics(df: DataFrame) -> DataFrame:
    """One row: total_patterns, unique_types, avg_pattern_length, max_pattern_length."""
    return df.agg(F.count("*").alias("total_patterns"), F.count_distinct("pattern_type").alias("unique_types"), F.avg("pattern_length").alias("avg_pattern_length"), F.max("pattern_length").alias("max_pattern_length"))


def pattern_summary(df: DataFrame, columns: tuple[str, ...] = ("support", "confidence", "lift")) -> DataFrame:
    """For each of the columns a row: column, n, mean, std (sample), least, q1, median, q3, largest; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(pairs)).where("x is not null")
    plain = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("largest"))
    cuts = quantiles(long, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ("column",))
    return plain.join(cuts, "column").select("column", "n", "mean", "std", "least", "q1", "median", "q3", "largest")


def top_patterns(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.orderBy(F.desc("support"), F.desc("confidence"), "pattern_id").limit(n)


def export_top_patterns(df: DataFrame, path: str, n: int = 1000) -> None:
    """At most ``n`` rows, so one file."""
    top_patterns(df, n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def process_large(spark, path: str, out: str, top_n: int = 1000) -> dict:
    """Load, summarise, export: the one-call form."""
    from ..sources.matrix import load_patterns

    df, info = load_patterns(spark, path)
    export_top_patterns(df, f"{out}/top_patterns", top_n)
    return {**info, "statistics": pattern_statistics(df).first().asDict(), "summary": {r["column"]: r.asDict() for r in pattern_summary(df).collect()}}


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numbers, in order: what a heat map can show."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def query_table(df: DataFrame, columns: list[str] | None = None, where: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Some columns and rows of a store, by SQL expressions."""
    if where:
        df = df.where(where)
    if order:
        df = df.orderBy(F.expr(order) if not order.lower().endswith(" desc") else F.expr(order[:-5]).desc())
    return (df.select(*columns) if columns else df) if limit is None else (df.select(*columns) if columns else df).limit(limit)


def export_filtered(df: DataFrame, path: str, where: str | None = None, form: str = "parquet") -> int:
    """Write the rows that a condition keeps, as Parquet or CSV; their number."""
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown form: {form}")
    kept = query_table(df, where=where)
    writer = kept.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
    back = df.sparkSession.read
    return (back.option("header", True).csv(path) if form == "csv" else back.parquet(path)).count()


def tiles(cells: DataFrame, rows: str, cols: str, value: str, size: int = 100) -> DataFrame:
    """A matrix of cells (rows and cols from 0) as tiles of ``size`` squared: tile_row, tile_col, n, mean, least, largest.

    The overview of a matrix that is too large to draw; a tile's own cells are a filter away.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return cells.groupBy(at(rows).alias("tile_row"), at(cols).alias("tile_col")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"))
