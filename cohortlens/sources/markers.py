"""Isolates described in words: a panel of patterns turns a report's text into the features it mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mentioned(panel: dict[str, str], text: Column) -> Column:
    """Names of the patterns found in the text, in the panel's order; none for a null text.

    The whole text is searched, in the JVM, once for each pattern that it doesn't hold early on.
    """
    if not panel:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in panel.items()]))


def holding(conditions: dict[str, str]) -> Column:
    """Names of the SQL conditions that hold for a row (null: doesn't)."""
    if not conditions:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in conditions.items()]))


def with_markers(df: DataFrame, panel: dict[str, str], text_col: str = "text", out: str = "markers") -> DataFrame:
    return df.withColumn(out, mentioned(panel, F.col(f"`{text_col}`")))
