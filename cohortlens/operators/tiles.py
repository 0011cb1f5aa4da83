"""Scatter plots and heat maps of any number of points: counts by tile, at several levels of detail.

Points fall into the tiles of the finest level; each coarser level is summed from the one
below, four tiles into one, so the points are read once.  A tile's number interleaves the
bits of its two coordinates, which makes the tile above it the number without its last two
bits and keeps near tiles together in a table sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import settled

#: Levels at most: coordinates of 2^20 tiles a side, interleaved, fit in 40 bits.
DEEPEST = 20
# Masks and shifts that spread the low 32 bits of a number over its even bits.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def interleaved(x: Column, y: Column) -> Column:
    """The number whose even bits are x and odd bits y (whole numbers from 0 on)."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def parted(number: Column) -> tuple[Column, Column]:
    """x and y of ``interleaved``."""

    def gathered(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
        for (by, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0x00000000FFFFFFFF]):
            v = v.bitwiseOR(F.shiftright(v, by)).bitwiseAND(F.lit(mask))
        return v

    return gathered(number), gathered(F.shiftright(number, 1))


def pyramid(points: DataFrame, x: str, y: str, category: str | None = None, value: str | None = None, finest: int = 8, levels: int | None = None) -> DataFrame:
    """level, tile_x, tile_y, category, n and total: points in each tile that has any, from ``finest`` (2^finest tiles a side) to coarser.

    The tiles part the span of the points' own coordinates; the largest one belongs to the
    last tile, and where all are equal there is one tile.  Points with a null or NaN
    coordinate are left out; ``total`` sums ``value`` (null without one), ``category`` is
    null without one.  ``levels``: how many, down to a single tile by default.
    """
    if not 0 <= finest <= DEEPEST:
        raise ValueError(f"levels are 0 to {DEEPEST}")
    levels = finest + 1 if levels is None else min(levels, finest + 1)
    kind = F.lit(None).cast("string") if category is None else F.col(category).cast("string")
    worth = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    at = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), kind.alias("category"), worth.alias("_value")).where("_x = _x and _y = _y and not isnan(_x) and not isnan(_y)")
    span = at.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))
    side = 1 << finest
    tile = lambda v, a, b: F.when(F.col(b) > F.col(a), F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * side), F.lit(side - 1))).otherwise(0).cast("long")
    placed = at.crossJoin(F.broadcast(span)).select(interleaved(tile("_x", "x0", "x1"), tile("_y", "y0", "y1")).alias("tile"), "category", "_value")
    level = settled(placed.groupBy("tile", "category").agg(F.count("*").alias("n"), F.sum("_value").alias("total")))
    out = None
    for depth in range(finest, finest - levels, -1):
        tx, ty = parted(F.col("tile"))
        here = level.select(F.lit(depth).alias("level"), tx.alias("tile_x"), ty.alias("tile_y"), "category", "n", "total")
        out = here if out is None else out.union(here)
        if depth > finest - levels + 1:
            level = settled(level.groupBy(F.shiftright("tile", 2).alias("tile"), "category").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return out


def view(tiles: DataFrame, level: int, left: int, right: int, low: int, high: int) -> DataFrame:
    """The tiles of a level between the coordinates, ends included."""
    return tiles.where((F.col("level") == level) & F.col("tile_x").between(left, right) & F.col("tile_y").between(low, high))
