"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key (hash of the text, id, place), so equal texts lie
together.  The driver holds only candidate boundaries of the key: each round
counts the exact bytes below all candidates in one grouped sum, keeps for every
splitter the interval that holds its target and divides it again.  A splitter is
done when the bytes below it are within the tolerance of the target, or its
interval can't be divided.  Where one text has more bytes than the tolerance
allows, its rows are divided by id, and equal (text, id) rows by their place.
Then every row is exchanged once, by range of the shard and the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .scratch import Scratch, partitions

#: Candidate boundaries in an open interval and round (a power of two; later rounds divide by 1024).
PROBES = 1024
#: Allowed distance of a splitter from its target, as a part of a shard's bytes.
TOLERANCE = 1 / 512


def _search(keys: DataFrame, level: str, targets: list[int], slack: float) -> list[tuple[int, int, int]]:
    """For each target: (boundary, bytes below it, bytes of the rows whose key is the boundary, or 0 if it is near enough).

    A boundary means: rows with a key below it come before.  A round's candidates are
    the multiples of a power of two inside the open intervals; one grouped sum counts
    the exact bytes between them all.
    """
    lo, hi = keys.agg(F.min(level), F.max(level)).first()
    shift = 0
    while (hi >> shift) - (lo >> shift) >= PROBES:
        shift += 1
    above = 64
    # open intervals: prefix of the key (above ``above`` bits), bytes below it
    spans: dict[int, tuple[int | None, int]] = {t: (None, 0) for t in targets}
    done: dict[int, tuple[int, int, int]] = {}
    while True:
        active = sorted({p for p, _ in spans.values() if p is not None})
        rows = keys.where(F.shiftright(level, above).isin(active)) if active else keys
        prefix = F.shiftright(level, shift) if shift else F.col(level)
        found: dict[int | None, list] = {}
        for r in rows.groupBy(prefix.alias("p")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            found.setdefault(r["p"] >> (above - shift) if active else None, []).append((r["p"], r["bytes"], r["n"]))
        for t, (parent, under) in list(spans.items()):
            for p, size, n in sorted(found[parent]):
                if under + size > t or (p << shift) == hi or under + size == t:
                    break
                under += size
            if abs(under - t) <= slack or n == 1 and 2 * (t - under) <= size:
                done[t] = (p << shift, under, 0)
            elif (abs(under + size - t) <= slack or n == 1) and (p + 1) << shift < 1 << 63:
                done[t] = ((p + 1) << shift, under + size, 0)
            elif not shift:
                done[t] = (p, under, size)
            else:
                spans[t] = (p, under)
                continue
            del spans[t]
        if not spans:
            return [done[t] for t in targets]
        above, shift = shift, max(0, shift - 10)


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None, int | None]]:
    """Up to ``shards - 1`` ascending (hash, id, place) boundaries; None stands below every value."""
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    targets = [total * s // shards for s in range(1, shards)]
    out: list = []
    for t, (h, under, inside) in zip(targets, _search(keys, "h", targets, slack)):
        if not inside:
            out.append((h, None, None))
            continue
        same = keys.where(F.col("h") == h)
        (i, under2, inside2), = _search(same, "id_key", [t - under], slack)
        if not inside2:
            out.append((h, i, None))
            continue
        rows = same.where(F.col("id_key") == i)
        (u, _, inside3), = _search(rows, "place", [t - under - under2], slack)
        # one row can't be cut: the nearer side
        out.append((h, i, u + 1 if inside3 and 2 * (t - under - under2) > inside3 else u))
    least = -(1 << 63)
    return sorted(out, key=lambda b: tuple(least if x is None else x for x in b))


def _shard_of(bounds: list[tuple]) -> Column:
    """Number of boundaries at or below the row."""
    shard = F.lit(0)
    for h, i, u in bounds:
        at = F.col("h") > h
        same = F.col("h") == h
        if i is None:
            at = at | same
        else:
            inner = F.col("id_key") > i
            inner = inner | (F.col("id_key") == i) if u is None else inner | ((F.col("id_key") == i) & (F.col("place") >= u))
            at = at | (same & inner)
        shard = shard + F.when(at, 1).otherwise(0)
    return shard.cast("int")


def histogram_sort_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                          keep: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``keep`` columns (all by default) with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``.

    ``size`` is the UTF-8 length plus 1 (null text: 1).  Law ``bytes``: the shards'
    sizes differ from their mean by little more than the tolerance or one row.  Equal
    texts lie together, but for those across a boundary.  ``slot`` counts from 0 in each
    shard without gaps.  Ids that aren't whole numbers count by their hash; null ids come first among equal texts; repeated rows are
    rows of their own; columns named like the results are replaced; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "law", "shard", "slot")]
    # The kept columns travel as one struct, so none of their names can meet a name used here.
    row = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_end"))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(row.alias("row"), F.octet_length(body).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"),
                       F.xxhash64(body).alias("_h"), F.coalesce(own, F.lit(-(1 << 63))).alias("_id"),
                       F.monotonically_increasing_id().alias("_place"))
    rows = scratch.table(rows.withColumn("_size", F.col("_size") + 1), "keys")
    keys = rows.select(F.col("_size").alias("size"), F.col("_h").alias("h"), F.col("_id").alias("id_key"), F.col("_place").alias("place"))
    bounds = splitters(keys, shards, tolerance)
    placed = rows.withColumnsRenamed({"_h": "h", "_id": "id_key", "_place": "place"}).withColumn("shard", _shard_of(bounds))
    sorted_ = placed.repartitionByRange(partitions(spark), "shard", "h", "id_key", "place").sortWithinPartitions("shard", "h", "id_key", "place")
    here = F.monotonically_increasing_id()
    sorted_ = scratch.table(sorted_.select("row", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
                                           F.shiftright(here, 33).alias("_part"), here.bitwiseAND((1 << 33) - 1).alias("_row")), "sorted")
    # Rows of a shard before this partition: one number for each (partition, shard), at most partitions + shards in all.
    runs = sorted_.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_row").alias("head"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "shard", (before - F.col("head")).alias("_base"))
    out = sorted_.join(F.broadcast(runs), ["_part", "shard"])
    return out.select(*[F.col(f"row.`{c}`") for c in names], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") + F.col("_base")).alias("slot"))
