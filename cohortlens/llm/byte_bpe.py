"""Byte-level BPE: Spark higher-order functions fold ranked merges over words.

A *word* is a run of text without white space and the space before it; no match of
the pattern crosses its edges.  The corpus' words are counted, and the most frequent
ones, up to a fixed number, are encoded in Spark: each match of the pattern becomes
an array of bytes, and ``aggregate`` merges the adjacent pair of the lowest rank
until no pair has a rank.  Ranks are looked up in a literal map, a cuckoo table of
two constant arrays, in two probes at most.  The result is a dictionary of bounded
size that every worker holds.

Rarer words, and texts with other white space than single spaces and line feeds, are
folded by the same rule where they occur: there is no bound on the number of distinct
words, so they can't all be handed to every worker, and a join on every occurrence
would shuffle several times the text.

Decoding is Spark's: each id's piece is looked up in a literal table, and the pieces
are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch, prepare, tidy

#: Words in the dictionary, and the longest, in bytes.
DICTIONARY = 1 << 16
LONGEST = 48
#: Rare words that a worker remembers.
MEMO = 700_000
_WHITE = r"\p{White_Space}"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ---- the literal rank map -------------------------------------------------------------------


def cuckoo(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(hashes, ranks) of a table in which each key is in one of its two slots."""
    import xxhash

    size = 1 << (2 * len(ranks)).bit_length()
    keys, values = [0] * size, [-1] * size
    for piece, rank in ranks.items():
        h = xxhash.xxh64_intdigest(piece, seed=42)
        h -= (h >> 63) << 64
        at = None
        for _ in range(500):
            a, b = _slots(h, size)
            if values[a] < 0 or values[b] < 0:
                at = a if values[a] < 0 else b
                keys[at], values[at] = h, rank
                break
            at = b if at == a else a
            keys[at], h = h, keys[at]
            values[at], rank = rank, values[at]
        else:
            raise ValueError("the cuckoo table is too full")
    return keys, values


def _slots(h: int, size: int) -> tuple[int, int]:
    return h % size, (h >> 24) % size


class RankMap:
    """The table as literals, and a lookup in it: the rank of a binary column, null if it has none."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = cuckoo(ranks)
        self.size = len(keys)
        # Constants: the optimizer folds the split and the cast into literals.
        self.literal = F.struct(F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>").alias("keys"),
                                F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>").alias("values"))

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` with the lookup; the literals stand in the plan once, however often it looks up."""
        return F.element_at(F.transform(F.array(self.literal), lambda t: body(lambda piece: self._rank(t, piece))), 1)

    def _rank(self, table: Column, piece: Column) -> Column:
        def probe(h: Column) -> Column:
            a = F.pmod(h, F.lit(self.size)).cast("int") + 1
            b = F.pmod(F.shiftright(h, 24), F.lit(self.size)).cast("int") + 1
            at = F.when(F.element_at(table["keys"], a) == h, a).when(F.element_at(table["keys"], b) == h, b)
            found = F.element_at(table["values"], at)
            return F.when(found >= 0, found)

        # one hash for both probes
        return F.element_at(F.transform(F.array(F.xxhash64(piece)), probe), 1)


def fold_merges(match: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of one match: bytes, merged pair by pair from the lowest rank."""
    raw = match.cast("binary")

    def step(state: Column, _: Column) -> Column:
        pieces = state["pieces"]
        scored = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: rank(F.concat(p, F.element_at(pieces, i + 2))))

        def merge(at: Column) -> Column:
            # 0 or null: no pair has a rank
            joined = F.concat(F.slice(pieces, 1, at - 1), F.array(F.concat(F.element_at(pieces, at), F.element_at(pieces, at + 1))),
                              F.slice(pieces, at + 2, F.size(pieces)))
            return F.when(at > 0, F.struct(joined.alias("pieces"), F.lit(False).alias("done"))).otherwise(
                F.struct(pieces.alias("pieces"), F.lit(True).alias("done")))

        # lambdas over arrays of one element bind a value that is used several times; array_position gives the leftmost
        once = F.transform(F.array(scored), lambda s: F.array_position(s, F.array_min(s)).cast("int"))
        go = ~state["done"] & (F.size(pieces) > 1)
        return F.when(go, F.element_at(F.transform(once, merge), 1)).otherwise(state)

    n = F.octet_length(match)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(raw, i, F.lit(1)))
    start = F.struct(single.alias("pieces"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.transform(s["pieces"], rank))
    whole = rank(raw)  # a match that is a piece itself is that piece
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(folded)


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str, word_col: str = "word") -> DataFrame:
    """``word_col`` and ``ids array<int>`` of distinct words, in Spark's own expressions."""
    table = RankMap(ranks)
    matches = F.regexp_extract_all(F.col(word_col), F.lit("(?U)" + pattern), F.lit(0))
    return words.withColumn("ids", table.bound(lambda rank: F.flatten(F.transform(matches, lambda m: fold_merges(m, rank)))))


# ---- rare words, in a worker ----------------------------------------------------------------


def fold(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one match; a heap keeps long ones from taking quadratic time."""
    if raw in ranks:
        return [ranks[raw]]
    if len(raw) > 64:
        return _fold_long(raw, ranks)
    pieces = [raw[i : i + 1] for i in range(len(raw))]
    none = 1 << 60
    scores = [ranks.get(pieces[i] + pieces[i + 1], none) for i in range(len(pieces) - 1)]
    while scores:
        low = min(scores)
        if low == none:
            break
        i = scores.index(low)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = ranks.get(pieces[i - 1] + pieces[i], none)
        if i < len(scores):
            scores[i] = ranks.get(pieces[i] + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _fold_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(raw)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # a piece is raw[i : end[i]]
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = end[i]
    return out


_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def plain(text: str) -> bool:
    """White space is single spaces and line feeds inside the text, so words can be told by splitting."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD.search(text))


class _Words(dict):
    """Packed ids of words with what goes before them; rare ones are folded on the way."""

    def __init__(self, known: dict[str, bytes], encoder: TextEncoder, lead: str, most: int):
        super().__init__(known)
        self.encoder, self.lead, self.most = encoder, lead, len(known) + most

    def __missing__(self, word: str) -> bytes:
        out = self.encoder.matches(self.lead + word)
        if len(self) < self.most and len(word) <= LONGEST:
            self[word] = out
        return out


class TextEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, words: dict[str, bytes]):
        import regex

        self.ranks = ranks
        exact = pattern.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\s", _WHITE).replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(exact).findall
        self.inner = _Words({w[1:]: x for w, x in words.items() if w.startswith(" ")}, self, " ", MEMO)
        self.first = _Words({w: x for w, x in words.items() if not w.startswith(" ")}, self, "", MEMO // 8)
        self.feed = self.matches("\n")

    def matches(self, text: str) -> bytes:
        out = []
        for m in self.find(text):
            # a match is also the word it would be on its own
            table, key = (self.inner, m[1:]) if m[0] == " " else (self.first, m)
            x = table.get(key)
            if x is None:
                x = array("I", fold(m.encode(), self.ranks)).tobytes()
                if len(table) < table.most and len(m) <= LONGEST:
                    table[key] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not plain(text):
            return self.matches(text)
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            if out:
                out.append(self.feed)
            out.append(self.first[words[0]])
            out.extend(map(self.inner.__getitem__, words[1:]))
        return b"".join(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times); in texts with other white space than single spaces and line feeds, of the words that it leaves."""
    first: Counter = Counter()
    inner: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = [*first, *(" " + w for w in inner)]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*first.values(), *inner.values()], pa.int64())], ["word", "times"])
        first.clear()
        inner.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and plain(text):
                for line in text.split("\n"):
                    words = line.split(" ")
                    first[words[0]] += 1
                    inner.update(words[1:])
            elif text:
                for line in text.split("\n"):
                    words = line.split()
                    if words and line[0] == words[0][0]:
                        first[words.pop(0)] += 1
                    inner.update(words)
        if len(inner) > MEMO // 2:
            yield flush()
    yield flush()


def frequent_words(docs: DataFrame, scratch: Scratch, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """At most ``most`` words of at most ``LONGEST`` bytes, with their leading space: those above the least count that leaves so many.

    A histogram of the counts' magnitudes gives that count, so nothing is sorted and no
    task gathers candidates.
    """
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_count), "word string, times long")
    total = counted.groupBy("word").agg(F.sum("times").alias("times")).where((F.col("times") > 1) & (F.octet_length("word") <= LONGEST) & (F.length("word") > 0))
    total = scratch.table(total, "counts")
    level = F.floor(F.log2("times") * 64).cast("int")
    hist = sorted(((r["level"], r["n"]) for r in total.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some thousand levels at most
    least, kept = None, 0
    for at, n in hist:
        kept += n
        if kept > most:
            break
        least = at
    return total.where(level >= least if least is not None else F.lit(False)).select("word")


def build_dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", most: int = DICTIONARY) -> dict[str, bytes]:
    """Packed ids of the most frequent words; at most ``most`` entries come to the driver."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    words = frequent_words(docs, scratch, text_col, most)
    spread = words.repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    rows = encode_words(spread, ranks, pattern).select("word", F.concat_ws(",", "ids").alias("ids")).toArrow()
    return {w: np.array(x.split(",") if x else [], "<u4").tobytes() for w, x in zip(rows["word"].to_pylist(), rows["ids"].to_pylist())}


_encoders: dict[int, TextEncoder] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY, ids: bool = False) -> DataFrame:
    """One row for each input row: id, n_tokens, ids_sha256, decoded_sha256, and ``ids array<int>`` if asked.

    ``ranks_path`` is read on the driver.  Null texts count as empty (no tokens).  Null
    ids and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    ranks = load_ranks(ranks_path)
    words = build_dictionary(docs, ranks, pattern, text_col, most)
    shared = spark.sparkContext.broadcast((ranks, pattern, words))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TextEncoder(*shared.value)
        encoder = _encoders[key]
        for batch in batches:
            packed = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in packed], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), lists], ["id", "n_tokens", "ids_sha256", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, ids array<int>")
    out = out.select("id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"), *["ids"] * ids)
    return out.withColumnRenamed("id", id_col)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, from a table that is one literal of the plan, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


def decode_ids(ids: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary`` of an ``array<int>`` of ids; null ids give null."""
    return ids.withColumn("decoded", decoded(F.col(ids_col), load_ranks(ranks_path)))
