"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that a sheet's name can't have, and its longest length.
FORBIDDEN, LONGEST = ":\\/?*[]", 31


def sheet_name(name: Column) -> Column:
    return F.substring(F.translate(name, FORBIDDEN, "_" * len(FORBIDDEN)), 1, LONGEST)
