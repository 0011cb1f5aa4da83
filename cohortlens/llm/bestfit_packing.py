"""Best-two-fit packing of tokenised documents into sequences.

Only the histogram of piece lengths is packed, so the work doesn't grow with the
number of documents: a step takes one *pattern* of lengths and uses it as often as
the lengths left allow, which exhausts a length, so there are at most as many
patterns as lengths.  A pattern starts with the largest length left and is filled
greedily with the largest that fits; then its smallest document is replaced by two
unpacked ones that fit the gap without it more tightly, if there are such.

Pieces then take their places: each has a rank among those of its length (counted
per partition, summed over partitions), and the plan says for each length which
ranks go to which sequences at which offset.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch, prepare, tidy

CAPACITY = 4096
END_ID = 1
#: Chunks whose ids a worker remembers, and the longest of them in characters; others are tokenised once for each batch.
MEMO, MEMO_LONGEST = 1_000_000, 64


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(times, lengths of a sequence, largest first)] that uses up the histogram."""
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    sizes = sorted(left)
    out = []

    def fits(most: int, used: Counter) -> int | None:
        """Largest length <= most that isn't used up by the pattern."""
        i = bisect.bisect_right(sizes, most) - 1
        while i >= 0 and left[sizes[i]] - used[sizes[i]] <= 0:
            i -= 1
        return sizes[i] if i >= 0 else None

    def two_that_fit(room: int, least: int, used: Counter) -> tuple[int, int] | None:
        """Two lengths with the largest sum in (least, room]."""
        best, found = least, None
        i, j = 0, bisect.bisect_right(sizes, room) - 1
        while i <= j:
            a, b = sizes[i], sizes[j]
            if left[a] - used[a] <= 0:
                i += 1
            elif left[b] - used[b] <= 0:
                j -= 1
            elif a + b > room:
                j -= 1
            else:
                if a + b > best and (a != b or left[a] - used[a] >= 2):
                    best, found = a + b, (b, a)
                    if best == room:
                        break
                i += 1
        return found

    while sizes:
        used: Counter = Counter()
        pattern: list[int] = []
        room = capacity
        while (x := fits(room, used)) is not None:
            # as often as it fits: a run of equal lengths is one step
            times = min(room // x, left[x] - used[x])
            pattern += [x] * times
            used[x] += times
            room -= x * times
        if room and len(pattern) > 1:
            smallest = pattern[-1]
            used[smallest] -= 1
            pair = two_that_fit(room + smallest, smallest, used)
            if pair:
                pattern[-1:] = pair
                used.update(pair)
            else:
                used[smallest] += 1
        times = min(left[x] // n for x, n in used.items() if n)
        out.append((times, sorted(pattern, reverse=True)))
        for x, n in used.items():
            left[x] -= n * times
        sizes = [x for x in sizes if left[x] > 0]
    return out


def plan_intervals(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, arrays (first rank, pieces in a sequence, first sequence, offset), by first rank."""
    taken: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for x, n in sorted(Counter(lengths).items(), reverse=True):
            rows.setdefault(x, []).append((taken[x], n, sequence, offset))
            taken[x] += n * times
            offset += x * n
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def splits_at_spaces(spec: dict) -> bool:
    """Is a text's encoding that of its parts between spaces, by the tokenizer's own description.

    So it is if the normaliser works on characters and turns white space into a space,
    and the first pre-tokenizer drops white space: then no merge crosses a space.
    """
    def parts(x: dict | None, name: str) -> list[dict]:
        return [] if x is None else [y for z in x[name] for y in parts(z, name)] if x["type"] == "Sequence" else [x]

    plain = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
    norm, pre = parts(spec.get("normalizer"), "normalizers"), parts(spec.get("pre_tokenizer"), "pretokenizers")
    if not pre or not all(n["type"] in plain or n["type"] == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in norm):
        return False
    first = pre[0]
    drops = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(drops) and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens") or [])


class ChunkEncoder:
    """Packed little-endian 32-bit ids of a text: chunk by chunk between spaces where the tokenizer allows it, else as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.known = _Memo()
        # A pattern may still cross spaces: ask the pre-tokenizer, too.
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str("it's a b  c1 ,d") if self.tokenizer.pre_tokenizer else [(" ", (0, 15))]
        with open(path, encoding="utf-8") as f:
            self.by_chunk = splits_at_spaces(json.load(f)) and not any(" " in "it's a b  c1 ,d"[a:b] for _, (a, b) in found)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        chunked = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        new = [c for c in set().union(*chunked) if c not in known]
        fresh = {}
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                fresh[word] = array("I", e.ids).tobytes()
        known.batch = fresh
        out = [b"".join(map(known.__getitem__, words)) for words in chunked]
        if len(known) + len(fresh) <= MEMO:
            known.update((w, x) for w, x in fresh.items() if len(w) <= MEMO_LONGEST)
        known.batch = {}
        return out


class _Memo(dict):
    """Remembered chunks, and behind them those of the batch at hand."""

    batch: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.batch[chunk]


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for i, packed in zip(ids, _encoder(path).encode(texts)):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    body = packed[at : at + 4 * capacity]
                    n = len(body) // 4
                    rows.append((i, piece, at // 4, n, zlib.crc32(body), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _places(intervals: dict[int, tuple[np.ndarray, ...]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                at = order[a:b]
                x = int(length[at[0]])
                first, many, start, place = intervals[x]
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                sequence[at] = start[k] + inside // many[k]
                offset[at] = place[k] + inside % many[k] * x
            keep = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file on every executor, of any shape.  A document is its
    ids followed by ``end_id``; null texts count as empty (one piece of ``end_id`` alone).
    Longer documents are cut into full pieces and a last one.  Repeated rows and null
    ids are packed like others; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    # Written once: a piece's partition and rank must not change if a task runs again.
    pieces = scratch.table(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tidy(_cut(tokenizer, capacity, end_id)), f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"), "pieces")
    counts = scratch.table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "length", before.alias("base"))
    # the counts grow with the partitions: never broadcast
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    out = ranked.mapInArrow(tidy(_places(plan_intervals(plan_packing(histogram, capacity)))),
                            f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
