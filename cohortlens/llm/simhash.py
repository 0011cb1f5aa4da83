"""SimHash fingerprints of documents, and search within a Hamming radius.

A text's terms are its distinct windows of three A-Z-lowered words (all words
where there are fewer), each weighted by 1 + ln(times it occurs).  A term's
128-bit hash votes with its weight for each of its set bits and against each
other; the fingerprint has the bits with more votes for than against.

``near_fingerprints`` finds all fingerprints within a radius r by block tables: the
bits are cut into 8 blocks of 16, and two fingerprints that differ in r bits at most
differ in r / 8 bits at most in one block.  There is a table for each block; the larger
side is stored once in each, the queries look up all values of their block in that
reach.  No pair is missed, and a pair counts in the first block that finds it.

A table is dealt out by as many of its block's highest bits as its rows ask for
(``GROUP_ROWS``); a group that is still too large, as many fingerprints share those bits,
is split by a salt, and so are the queries where there are many.  A task so meets at most
about ``MOST_ROWS`` stored fingerprints and as many queries, whatever the number of rows.
For random bits a query meets 697 / 65536 of each table, 8.5% of all rows in the eight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .scratch import Scratch, below, partitions, prepare, tidy
from .shingles import U64, mix, slices, text_bytes, windows, word_hashes, word_spans

BITS = 128
#: Words of a term.
TERM = 3
#: Bits that texts may differ in to be near: the widest radius at which one of 8 blocks differs in 3 bits at most, so wider
#: costs more lookups and narrower loses pairs with 3/4 or more of their terms in common (see README).
RADIUS = 31
#: Block tables of 16 bits; pairs compared at once.
BLOCKS, AT_ONCE = 8, 1 << 20
#: Rows of a group that are aimed at, the bits at least (so that a small table is spread too) and at most that make groups,
#: and rows of a group and queries that a task meets at most.
GROUP_ROWS, LEAST_BITS, MOST_BITS, MOST_ROWS = 1 << 16, 4, 12, 1 << 20
#: Stands for a null id: it comes before all others.
NO_ID = -(1 << 63)
#: Bytes of text whose terms are hashed together: some 100 bytes of tables for each.
TOGETHER = 1 << 18
_SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) == 1, 1.0, -1.0)


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """16-byte fingerprints; texts without words get zeros."""
    out: list[bytes] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
            size += len(texts[j])
            j += 1
        out += _some(pa.array(texts[i:j], pa.binary()))
        i = j
    return out


def _some(column: pa.Array) -> list[bytes]:
    raw, at = text_bytes(column)
    s, e, first = word_spans(raw, at)
    h, pos = windows(word_hashes(raw, s, e), first, TERM)
    out = []
    for a, b in zip(pos[:-1], pos[1:]):
        if a == b:
            out.append(bytes(BITS // 8))
            continue
        term, times = np.unique(h[a:b], return_counts=True)
        weight = 1 + np.log(times)
        # Bytes of the hash: each position has a histogram of byte values, so no term is spread into bits.
        halves = np.stack([term, mix(term + U64(0x632BE59BD9B4E019))], 1).view(np.uint8).reshape(len(term), BITS // 8)
        flat = (halves.astype(np.int64) + np.arange(BITS // 8) * 256).ravel()
        votes = np.bincount(flat, np.repeat(weight, BITS // 8), BITS // 8 * 256).reshape(BITS // 8, 256) @ _SIGNS
        out.append(np.packbits(votes.ravel() > 1e-9).tobytes())
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of the partition; a row marked ``guest`` only lends its text to the one before it."""
    held = None  # (id, text, fingerprint)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", *_OUT])

    for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column("text"), 4 * TOGETHER)):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        own = fingerprints([t.encode() for t in texts])
        chain = ([held] if held else []) + list(zip(batch.column("id").to_pylist(), texts, own, batch.column("guest").to_pylist()))
        pairs = [(x, y, edited(x[1], y[1])) for x, y in zip(chain, chain[1:]) if not x[3]]
        raw = [t.encode() for _, _, t in pairs]
        yield flush([(x[0], len(x[1]), hashlib.sha256(r).hexdigest(), x[2].hex(), f.hex(), likeness(x[2], f), likeness(x[2], y[2]))
                     for (x, y, _), r, f in zip(pairs, raw, fingerprints(raw))])
        held = None if chain[-1][3] else chain[-1]
    if held:
        raise RuntimeError("a partition has to end with the text that follows it")


def simhash_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are in a circle by ascending id (null ids first, equal ids by text); each is
    compared with its neighbour and with itself edited (see ``edited``).  Null texts
    count as empty; texts without words have a fingerprint of zeros; a single row is
    its own neighbour.  Ids are whole numbers (others raise); texts of any length are read
    whole; other columns are ignored; an empty table gives no rows.

    One exchange by range of the id brings neighbours together; only the first row of
    each partition is sent once more, to the partition before it.
    """
    spark = docs.sparkSession
    prepare(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number: its order makes the circle")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Boundaries from the ids alone.
    ids = rows.select("id")
    count = partitions(spark)
    cuts = sorted({x for x in (ids.approxQuantile("id", [k / count for k in range(1, count)], 0.2 / count) if count > 1 else [])})
    rows = rows.withColumn("part", below([int(c) for c in cuts], F.col("id")))
    first = rows.groupBy("part").agg(F.min("id").alias("head")).withColumnRenamed("part", "of")
    heads = rows.join(F.broadcast(first), (F.col("part") == F.col("of")) & (F.col("id") == F.col("head")))
    heads = heads.groupBy("part", "id").agg(F.min("text").alias("text"))
    circle = Window.partitionBy(F.lit(0))  # one row for each partition
    heads = heads.select("id", "text", F.lag("part").over(circle.orderBy("part")).alias("before"), F.max("part").over(circle).alias("last"))
    guests = heads.select("id", "text", F.coalesce("before", "last").alias("part"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = both.repartitionByRange(count, "part").sortWithinPartitions("part", "guest", "id", "text").select("id", "text", "guest")
    out = dealt.mapInArrow(tidy(_pairs), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def _near(prints: np.ndarray, queries: np.ndarray, t: int, g: int, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, print, distance) of the pairs that block ``t`` is the first to find; all prints have its highest ``bits`` ``g``.

    Both are arrays of 8 blocks of 16 bits.
    """
    reach, low = radius // BLOCKS, (1 << 16 - bits) - 1
    order = np.argsort(prints[:, t] & low, kind="stable")
    sorted_prints = np.ascontiguousarray(prints[order])
    begin = np.searchsorted(sorted_prints[:, t] & low, np.arange(low + 2))
    p, q = sorted_prints.view(np.uint64), np.ascontiguousarray(queries).view(np.uint64)
    off = np.bitwise_count((queries[:, t] >> 16 - bits) ^ np.uint16(g))
    for mask in range(low + 1):
        wide = mask.bit_count()
        if wide > reach:
            continue
        some = np.flatnonzero(off + wide <= reach)
        at = ((queries[some, t] & low) ^ mask).astype(np.int64)
        first, many = begin[at], begin[at + 1] - begin[at]
        some, first, many = some[many > 0], first[many > 0], many[many > 0]
        ends = np.cumsum(many)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
            n = many[i:j]
            left = np.repeat(some[i:j], n)
            right = np.arange(n.sum()) + np.repeat(first[i:j] - np.cumsum(n) + n, n)
            distance = np.bitwise_count(q[left] ^ p[right]).sum(1)
            hit = np.flatnonzero(distance <= radius)
            left, right, distance = left[hit], right[hit], distance[hit]
            new = ~(np.bitwise_count(queries[left, :t] ^ sorted_prints[right, :t]) <= reach).any(1)
            yield left[new], order[right[new]], distance[new]
            i = j


def _meet(prints: DataFrame, queries: DataFrame, radius: int, solve, schema: str) -> DataFrame:
    """``solve(t, g, bits, prints, queries)`` for each block and value of its highest bits; ``prints`` are distinct and have a column times."""
    spark, scratch = prints.sparkSession, Scratch(prints.sparkSession, "blocks")
    prepare(spark)
    reach = radius // BLOCKS
    held = lambda df: df.where("fingerprint is not null")
    stored = scratch.table(held(prints).select("fingerprint", "times"), "stored")
    asked = scratch.table(held(queries).select("fingerprint").distinct(), "asked")
    n = stored.count()
    bits = min(MOST_BITS, max(LEAST_BITS, ((max(1, n) - 1) // GROUP_ROWS).bit_length()))
    masks = [m for m in range(1 << bits) if m.bit_count() <= reach]
    # queries of a group: all, by the share of the groups that each of them looks into
    parts = max(1, -(-asked.count() * len(masks) // ((1 << bits) * MOST_ROWS)))
    block = lambda t: F.shiftright(F.conv(F.substring("fingerprint", 1 + 4 * t, 4), 16, 10).cast("int"), 16 - bits)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), block(t).alias("g")) for t in range(BLOCKS)])
    stored = stored.select("fingerprint", "times", F.inline(keys))
    # groups too large for a task: at most one for each MOST_ROWS rows of a table, so their list is short
    hot = scratch.table(stored.groupBy("t", "g").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select("t", "g", F.ceil(F.col("n") / MOST_ROWS).cast("int").alias("salts")), "hot")
    salted = lambda df: df.join(F.broadcast(hot), ["t", "g"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    digest = lambda seed: F.xxhash64("fingerprint", F.lit(seed))
    stored = salted(stored).select("t", "g", F.pmod(digest(1), F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.unhex("fingerprint").alias("print"), "times")
    asked = asked.select("fingerprint", F.inline(keys)).select("fingerprint", "t", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("g").bitwiseXOR(m))).alias("g"))
    asked = salted(asked).select("t", "g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(digest(2), F.lit(parts)).cast("int").alias("part"), F.unhex("fingerprint").alias("print"))

    def blocks(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("print").to_pylist()), ">u2").astype(np.uint16).reshape(-1, BLOCKS)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return solve(key[0].as_py(), key[1].as_py(), bits, left, right, blocks(left), blocks(right))

    by = ["t", "g", "salt", "part"]
    return stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, schema)


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, fingerprint, distance) of hex fingerprints at most ``radius`` bits apart.

    Both inputs have a column ``fingerprint``; nulls are left out, repeated ones taken once;
    without rows on either side there are none.
    """
    def solve(t, g, bits, left, right, p, q):
        found = list(_near(p, q, t, g, bits, radius)) if len(p) and len(q) else []
        one = lambda k: np.concatenate([np.zeros(0, np.int64), *[f[k].astype(np.int64) for f in found]])
        names = lambda table, at: pa.array([table.column("print")[int(i)].as_py().hex() for i in at], pa.string())
        return pa.table([names(right, one(0)), names(left, one(1)), pa.array(one(2).astype(np.int32))], ["query", "fingerprint", "distance"])

    return _meet(prints.select("fingerprint").distinct().withColumn("times", F.lit(1).cast("long")), queries, radius, solve, "query string, fingerprint string, distance int")


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, found): the rows of ``prints``, repeated ones included, at most ``radius`` bits from each distinct query.

    Pairs are counted where they are found, so their number is never that of rows.  Nulls
    are left out; queries that find nothing, and all where a side is empty, give no row.
    """
    def solve(t, g, bits, left, right, p, q):
        sums = np.zeros(len(q), np.int64)
        if len(p) and len(q):
            times = left.column("times").to_numpy()
            for a, b, _ in _near(p, q, t, g, bits, radius):
                np.add.at(sums, a, times[b])
        at = np.flatnonzero(sums)
        return pa.table([pa.array([right.column("print")[int(i)].as_py().hex() for i in at], pa.string()), pa.array(sums[at])], ["query", "found"])

    many = prints.groupBy("fingerprint").agg(F.count("*").alias("times"))
    return _meet(many, queries, radius, solve, "query string, found long").groupBy("query").agg(F.sum("found").alias("found"))
