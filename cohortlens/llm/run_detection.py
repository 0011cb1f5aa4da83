"""Periodic runs of words: stretches that repeat one block of words several times.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``min_exponent`` * q and ``min_length`` words long, that no
neighbouring word extends keeping period q.  All lags up to n / ``min_exponent`` of a
text of n words are scanned: its array of word codes is compared with itself shifted by
the lag, and long enough stretches of equal places are runs.  A lag is first compared at
every q-th place only; as a run holds ``min_exponent`` - 1 such places in a row, lags
without them are done, and the others are compared in full.

A stretch found at a multiple of its smallest period is the same stretch (Fine and Wilf,
as it is two periods long at least), so the least lag of equal stretches is the period.

Texts of up to ``WHOLE_BYTES`` bytes are scanned where they are read, without an
exchange.  A longer one is dealt out by ranges of its lags, each of about ``RANGE_WORK``
comparisons at most, so that one text's scan is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, partitions, prepare, tidy
from .shingles import text_bytes, word_spans

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Longest text that is scanned by the task that reads it: at most 32,768 words, whose lags take 2^28 comparisons at worst.
WHOLE_BYTES = 1 << 16
#: Comparisons of a range of lags at worst, and its least number of lags (a range costs a copy of the text).
RANGE_WORK, RANGE_LAGS = 1 << 28, 1024
#: Bytes of texts whose words are coded together.
_TOGETHER = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words (equal words, and they alone, have equal codes), first word of each text (n + 1), bytes, starts and ends."""
    raw, at = text_bytes(texts)
    s, e, first = word_spans(raw, at)
    if not len(s):
        return np.zeros(0, np.int32), first, raw, s, e
    size = e - s
    offsets = np.concatenate([[0], np.cumsum(size)])
    # bytes of words only: each word's bytes lie offsets[i] - s[i] places before where they were
    data = raw[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - s, size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32), first, raw, s, e


def _hits(codes: np.ndarray, q: int, min_exponent: int) -> np.ndarray:
    """Places, multiples of q, from which ``min_exponent`` words q apart are equal."""
    every = codes[::q]
    same = every[1:] == every[:-1]
    row = same[min_exponent - 2 :]
    for k in range(min_exponent - 2):
        row = row & same[k : k + len(row)]
    return np.flatnonzero(row) * q


def _stretches(codes: np.ndarray, q: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches with period q of which ``need`` words in a row equal the words q later."""
    equal = np.zeros(len(codes) - q + 2, np.int8)
    equal[1:-1] = codes[q:] == codes[:-q]
    edge = np.flatnonzero(np.diff(equal))
    start, stop = edge[::2], edge[1::2]
    return [(int(start[i]), int(stop[i] - start[i] + q)) for i in np.flatnonzero(stop - start >= need)]


def scan_lags(codes: np.ndarray, low: int, high: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> dict[tuple[int, int], int]:
    """{(start, length): least period} of the runs whose lag is in low..high - 1."""
    found = {}
    for q in range(max(1, low), min(high, len(codes) // min_exponent + 1)):
        if len(_hits(codes, q, min_exponent)):
            for x in _stretches(codes, q, max(min_length - q, (min_exponent - 1) * q)):
                found.setdefault(x, q)
    return found


def scan_texts(codes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[dict[tuple[int, int], int]]:
    """The same for all lags of many texts at once: a lag is first compared in all texts that are long enough for it.

    The texts stand in one array, longest first, with codes that no two texts share.
    """
    size = np.diff(first)
    found: list[dict] = [{} for _ in size]
    order = np.argsort(-size, kind="stable")
    at = np.concatenate([[0], np.cumsum(size[order])])
    place = np.repeat(first[:-1][order] - at[:-1], size[order]) + np.arange(at[-1])
    flat = codes[place] + np.repeat(np.arange(len(order)), size[order]) * (int(codes.max(initial=0)) + 1)
    reach = size[order] // min_exponent
    for q in range(1, int(reach.max(initial=0)) + 1):
        many = int(np.searchsorted(-reach, -q, "right"))
        hits = _hits(flat[: at[many]], q, min_exponent)
        if len(hits):
            for r in np.unique(np.searchsorted(at, hits, "right") - 1).tolist():
                for x in _stretches(flat[at[r] : at[r + 1]], q, max(min_length - q, (min_exponent - 1) * q)):
                    found[order[r]].setdefault(x, q)
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _collapsed(view: bytes, s: np.ndarray, e: np.ndarray, keep: np.ndarray) -> str:
    return b" ".join(view[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist())).decode()


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    _, at = text_bytes(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(at, at[i] + _TOGETHER, "right")) - 1))
        yield i, texts.slice(i, j - i)
        i = j


def _finish(texts: pa.Array, runs_of) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_words, runs, collapsed) of texts; ``runs_of(row, codes, first)`` gives {(start, length): period} of each text from a row on."""
    words, runs, out = [], [], []
    for base, some in _chunks(texts):
        codes, first, raw, s, e = word_codes(some)
        view = raw.tobytes()
        for a, b, found in zip(first[:-1].tolist(), first[1:].tolist(), runs_of(base, codes, first)):
            own = sorted(((x[0], x[1], p) for x, p in found.items()), key=lambda x: (x[0], x[2]))
            words.append(b - a)
            runs.append([{"start": x, "length": y, "period": p} for x, y, p in own])
            out.append(_collapsed(view, s[a:b], e[a:b], kept_words(b - a, own)))
    return pa.array(words, pa.int64()), pa.array(runs, _RUN), pa.array(out, pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  whole_bytes: int = WHOLE_BYTES, range_work: int = RANGE_WORK, range_lags: int = RANGE_LAGS) -> DataFrame:
    """One row for each input row: id, n_words, runs (by start, then period), collapsed (the words in no run after its first period, joined by a space).

    Null and empty texts, and texts of white space, have no words, no runs and an empty
    collapsed text; repeated rows, null and equal ids give a row each; texts of any
    length are scanned whole and at all lags; other columns are ignored; an empty table
    gives no rows.  ``min_exponent`` is 2 or more, since of shorter stretches the
    smallest period isn't known from the lags alone.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    spark = docs.sparkSession
    prepare(spark)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > whole_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # told apart here, as a condition before would be computed with the text's whole expression once more
            batch = batch.filter(pc.less_equal(pc.binary_length(batch.column("text")), whole_bytes))
            done = _finish(batch.column("text"), lambda _, codes, first: scan_texts(codes, first, min_length, min_exponent))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *done], ["id", "n_words", "runs", "collapsed"])

    schema = f"id {key}, n_words long, runs {RUNS}, collapsed string"
    short = rows.mapInArrow(tidy(scan), schema)

    # Long texts: ranges of lags, of texts told apart by id and digest.
    held = Scratch(spark, "runs").table(rows.where(long).withColumn("digest", F.sha2("text", 256)), "long")
    at_most = F.floor(F.octet_length("text") / 2).cast("long") + 1  # words
    step = F.greatest(F.lit(range_lags), F.ceil(F.lit(range_work) / at_most)).cast("long")
    dealt = held.dropDuplicates(["digest"]).select("digest", "text", step.alias("step"), F.explode(F.sequence(F.lit(1).cast("long"), F.floor(at_most / min_exponent) + 1, step)).alias("low"))
    dealt = dealt.repartition(partitions(spark), "digest", "low").select("digest", "text", "low", (F.col("low") + F.col("step")).alias("high"))

    def scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lows, highs = (batch.column(c).to_pylist() for c in ("digest", "low", "high"))
            for r in range(batch.num_rows):
                codes = word_codes(batch.column("text").slice(r, 1))[0]
                found = scan_lags(codes, lows[r], highs[r], min_length, min_exponent)
                cols = [[digests[r]] * len(found), [x[0] for x in found], [x[1] for x in found], list(found.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "start", "length", "period"])

    found = dealt.mapInArrow(tidy(scan_range), "digest string, start long, length long, period long")
    least = found.groupBy("digest", "start", "length").agg(F.min("period").alias("period"))
    # A text has fewer runs than words, so its list is no longer than the text.
    listed = least.groupBy("digest").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            done = _finish(batch.column("text"), lambda r, *_: ({(x["start"], x["length"]): x["period"] for x in some or ()} for some in runs[r:]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *done], ["id", "n_words", "runs", "collapsed"])

    joined = held.join(listed, "digest", "left").select("id", "text", "runs")
    out = short.unionByName(joined.mapInArrow(tidy(finish), schema))
    return out.withColumnRenamed("id", id_col)


def crc_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts of which a tenth, chosen by h = crc32 of the decimal id, repeat a block of their words up to their end.

    Where h % 10 = 0, with g = floor(h / 10) and n > 0 words, each word i >= a becomes word a + (i - a) % p, a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), and the words are joined by a space.  Texts of a null id stay.
    """
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (computed once, however often it is used)
    text, h = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    whole = lambda c: c.cast("int")

    def repeat(w: Column, n: Column, a: Column, g: Column) -> Column:
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = let(p, lambda p: F.slice(F.flatten(F.array_repeat(F.slice(w, whole(a + 1), whole(p)), whole(F.ceil((n - a) / p)))), F.lit(1), whole(n - a)))
        return F.array_join(F.concat(F.slice(w, F.lit(1), whole(a)), tail), " ")

    g, long = F.floor(h / 10).cast("long"), lambda c: c.cast("long")
    changed = let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.when(F.size(w) > 0, repeat(w, long(F.size(w)), g % long(F.size(w)), g)))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.when(h % 10 == 0, changed), text).alias(text_col))


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("late"), (-r["period"]).alias("slow"))))
    return F.when(F.size(runs) > 0, F.struct((-best["late"]).alias("start"), best["length"].alias("length"), (-best["slow"]).alias("period")))
