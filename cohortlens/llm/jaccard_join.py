"""N-gram Jaccard self-join with signature trees.

Which texts link is decided exactly.  The steps:

1. Every text becomes a set of shingle hashes; equal sets (copies) are one class.
2. Shingles are dealt to buckets of the hash space as packed arrays.  A bucket
   counts in how many classes each of its shingles occurs and drops those of a
   single class: they can be in no overlap.  Shingles that the first scan finds
   frequent skip this, so that no bucket gathers a shingle of a third of all texts.
3. Each class orders its shingles by that count, rarest first, frequent ones last.  Two sets of the
   wanted similarity share a shingle among the first ``n - ceil(t n) + 1``; a class
   whose single-class shingles fill that prefix has no partner and is done.
4. In every group of classes with a common prefix shingle, each class is first
   held against the group's smallest one only (a number of pairs linear in the
   group's size), and verified links are merged into components.
5. Groups that still hold several components get a *signature tree*: leaves of
   classes ordered by size, inner nodes with the OR of their token bitmaps and
   their range of sizes.  A traversal of pairs of nodes goes down only where the
   largest possible overlap reaches the least required one and the two nodes
   aren't of one and the same component.  A first pass verifies only the likeliest
   pairs of any two components and merges again, so that two large components with
   many links between them don't give all those pairs; the second pass verifies
   exactly whatever the trees leave.

Shingles are compared by 64-bit hashes, in the verification too, and sets (classes) by
128-bit digests: two different shingles of one pair of texts would have to collide for a
wrong overlap, and two different sets of the whole corpus for a wrong class.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .scratch import Scratch, partitions, prepare, tidy
from .shingles import shingle_sets

_FLUSH = 1 << 20
#: A token is frequent in a run of texts (about a million tokens) from this number and this part of the texts on;
#: so many frequent tokens are known to all workers (8 bytes each).
FREQUENT_LEAST, FREQUENT_PART, FREQUENT_MOST = 16, 64, 1 << 20
#: Entries of a group that meet with as many others in a deal; larger groups have several deals.
GROUP = 512
def required_overlap(na, nb, num: int, den: int):
    """Least intersection of sets of these sizes whose Jaccard similarity is num/den."""
    return -(-num * (na + nb) // (den + num))


def prefix_length(n, num: int, den: int):
    return n + (-num * n) // den + 1


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def number_digests(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The place of each 16-byte digest among the distinct ones, and these in ascending order."""
    known = sorted({packed[i : i + 16] for i in range(0, len(packed), 16)})
    number = dict(zip(known, range(len(known))))
    return np.fromiter((number[packed[i : i + 16]] for i in range(0, len(packed), 16)), np.int64, len(packed) // 16), known


def _class_rows(text: str, k: int, id_type: pa.DataType):
    """Rows (id, n, digest) of the texts, and marked rows (null, count, null, token) of tokens frequent among a run of texts."""

    def frequent(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = count >= max(FREQUENT_LEAST, len(sets) // FREQUENT_PART)
        token, count = token[often].view(np.int64), count[often].astype(np.int64)
        return batch_of(pa.nulls(len(token), id_type), count, pa.nulls(len(token), pa.binary()), pa.array(token))

    def batch_of(ids, n, digest, token) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n), digest, token], ["id", "n", "digest", "frequent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        total = 0
        for batch in batches:
            col = batch.column(text)
            n, digest = np.zeros(len(col), np.int64), [b""] * len(col)
            for i, tokens in shingle_sets(col, k):
                n[i], digest[i] = len(tokens), set_digest(tokens)
                if len(tokens) and digest[i] not in sets:
                    sets[digest[i]] = tokens
                    total += len(tokens)
                    if total >= _FLUSH:
                        yield frequent(sets)
                        sets, total = {}, 0
            yield batch_of(batch.column("id"), n, pa.array(digest, pa.binary()), pa.nulls(len(col), pa.int64()))
        if sets:
            yield frequent(sets)

    return run


def frequent_tokens(classes: DataFrame, scratch: Scratch, most: int) -> np.ndarray:
    """At most ``most`` of the marked tokens, those with the largest counts; ascending.

    A histogram of the counts' magnitudes gives the least count, so nothing is sorted.
    """
    by = scratch.table(classes.where("frequent is not null").groupBy("frequent").agg(F.sum("n").alias("times")), "frequent")
    level = F.floor(F.log2("times") * 8).cast("int")
    hist = sorted(((r["level"], r["n"]) for r in by.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in hist:  # some hundred levels at most
        total += n
        if total > most:
            break
        least = at
    got = [] if least is None else by.where(level >= least).select("frequent").toArrow()["frequent"].to_numpy()
    scratch.drop(by)
    return np.sort(np.array(got, np.int64).view(np.uint64))


#: Stands for the number of classes of a frequent token: it sorts behind all counts.
_OFTEN = 0xFFFFFFFF


def _deal(bucket: np.ndarray, owner: np.ndarray):
    """For each bucket: (bucket, owners, how many tokens of each, positions)."""
    order = np.argsort(bucket, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for a, b in zip(head, [*head[1:], len(order)]):
        at = order[a:b]
        own = owner[at]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield int(bucket[at[0]]), own[first], np.diff(np.r_[first, len(own)]), at


_PACKED = "bucket int, classes binary, sizes binary, counts binary, tokens binary, extra binary"


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "classes", "sizes", "counts", "tokens", "extra"])


def _pack_tokens(text: str, k: int, buckets: int, frequent: Broadcast):
    """Rows of one bucket and one batch: classes (digest, size, how many tokens here), tokens.

    Frequent tokens are shared by what is known of them: they don't meet in a bucket of
    the token space, but go to the bucket of their class (numbered from ``buckets`` on).
    """

    def flush(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        known = np.frombuffer(frequent.value, np.uint64)
        digest = np.frombuffer(b"".join(sets), "<u8").reshape(-1, 2)
        size = np.array([len(x) for x in sets.values()], np.int64)
        token = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(size)), size)
        often = np.zeros(len(token), bool)
        if len(known):
            often = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
        bucket = np.where(often, buckets + class_bucket(digest, buckets)[owner], ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
        rows = []
        for b, own, many, at in _deal(bucket, owner):
            extra = np.full(len(at), _OFTEN, np.uint32).tobytes() if b >= buckets else b""
            rows.append((b, digest[own].tobytes(), size[own].astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), token[at].tobytes(), extra))
        pa.default_memory_pool().release_unused()
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        total = 0
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(text), k):
                if len(tokens) and (d := set_digest(tokens)) not in sets:
                    sets[d] = tokens
                    total += len(tokens)
                    if total >= _FLUSH:
                        yield flush(sets)
                        sets, total = {}, 0
        if sets:
            yield flush(sets)

    return run


def class_bucket(digest: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(digest[:, 0], np.uint64(buckets)).astype(np.int64)


def _unpack(group: pa.Table, extra: bool = False):
    """(token, class, size of the class, extra) of every entry of a bucket's rows, and the classes' digests by their numbers."""
    pa.default_memory_pool().release_unused()  # of the bucket before
    join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    many = join("counts", np.uint32)
    number, known = number_digests(b"".join(group.column("classes").to_pylist()))
    return join("tokens", np.uint64), np.repeat(number, many), np.repeat(join("sizes", np.uint32), many), join("extra", np.uint32) if extra else None, known


def _shared_tokens(buckets: int):
    """Tokens of two classes at least, dealt anew by class, with the number of classes."""

    def run(group: pa.Table) -> pa.Table:
        number = group.column("bucket")[0].as_py()
        if number >= buckets:  # a class's frequent tokens: already where they belong
            return group.set_column(0, "bucket", pa.array([number - buckets] * len(group), pa.int32()))
        token, cls, size, _, known = _unpack(group)
        order = np.argsort(token)
        t = token[order]
        new = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        twice = ~new | np.r_[~new[1:], False] if len(t) else new
        order = order[twice]
        order = order[np.lexsort((cls[order], token[order]))]
        t, c, s = token[order], cls[order], size[order]
        if len(t):
            one = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
            t, c, s = t[one], c[one], s[one]
            head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            df = np.diff(np.r_[head, len(t)])
            df = np.repeat(np.minimum(df, _OFTEN - 1), df)
            keep = df > 1
            t, c, s, df = t[keep], c[keep], s[keep], df[keep]
        if not len(t):
            return _table([])
        order = np.lexsort((t, c))
        t, c, s, df = t[order], c[order], s[order], df[order].astype(np.uint32)
        head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size, many = s[head], np.diff(np.r_[head, len(c)])
        digest = np.frombuffer(b"".join([known[i] for i in c[head].tolist()]), "<u8").reshape(-1, 2)
        part = class_bucket(digest, buckets)
        rows = []
        start = np.r_[0, np.cumsum(many)]
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            rows.append((int(p), digest[own].tobytes(), size[own].tobytes(), many[own].astype(np.uint32).tobytes(), t[at].tobytes(), df[at].tobytes()))
        return _table(rows)

    return run


_ALIVE = "digest binary, n int, tokens binary, prefix array<long>"


def _prefixes(num: int, den: int):
    """Classes that can have a partner: their shared tokens and the part of their prefix in them."""

    def run(group: pa.Table) -> pa.Table:
        token, cls, size, df, known = _unpack(group, extra=True)
        order = np.lexsort((token, df, cls))
        if len(order):  # copies of a class in several batches have each sent its frequent tokens
            order = order[np.r_[True, (token[order][1:] != token[order][:-1]) | (cls[order][1:] != cls[order][:-1])]]
        token, cls, size = token[order], cls[order], size[order].astype(np.int64)
        head = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, np.int64)
        out = ([], [], [], [])
        for a, b in zip(head, np.r_[head[1:], len(cls)]):
            n = int(size[a])
            left = prefix_length(n, num, den) - (n - (b - a))
            if left > 0:
                for col, x in zip(out, (known[cls[a]], n, np.sort(token[a:b]).tobytes(), token[a : a + left].view(np.int64))):
                    col.append(x)
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["digest", "n", "tokens", "prefix"])

    return run


def _overlaps(a: str, b: str, num: int, den: int):
    """Keep the pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            keep = []
            for x, y, least in zip(batch.column("ta"), batch.column("tb"), required_overlap(na, nb, num, den)):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(len(np.intersect1d(u, v, assume_unique=True)) >= least)
            yield batch.select([a, b]).filter(pa.array(keep, pa.bool_()))

    return run


_CANDIDATES = "a long, b long"


def _verified(pairs: DataFrame, alive: DataFrame, num: int, den: int) -> DataFrame:
    left = alive.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = alive.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    full = pairs.join(left, "a").join(right, "b").where(f"least(na, nb) * {den}L >= greatest(na, nb) * {num}L")
    return full.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(tidy(_overlaps("a", "b", num, den)), _CANDIDATES)


class SignatureTree:
    """Classes of one group in order of size; nodes hold OR-ed bitmaps and ranges.

    ``bits``: (m, w / 8) uint8 bitmaps of the classes' shared tokens; ``spare``: tokens
    beyond one for each set bit; ``label``: components.
    """

    FAN = 24

    def __init__(self, n, bits, spare, label):
        order = np.argsort(n, kind="stable")
        self.order, self.n, self.bits, self.spare, self.label = order, n[order], bits[order], spare[order], label[order]
        lo = np.arange(0, len(n), self.FAN)
        level = [lo, np.minimum(lo + self.FAN, len(n)), np.bitwise_or.reduceat(self.bits, lo), np.minimum.reduceat(self.n, lo),
                 np.maximum.reduceat(self.n, lo), np.maximum.reduceat(self.spare, lo), np.minimum.reduceat(self.label, lo), np.maximum.reduceat(self.label, lo)]
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), self.FAN)
            level = [at, np.minimum(at + self.FAN, len(level[0])), np.bitwise_or.reduceat(level[2], at), np.minimum.reduceat(level[3], at),
                     np.maximum.reduceat(level[4], at), np.maximum.reduceat(level[5], at), np.minimum.reduceat(level[6], at), np.maximum.reduceat(level[7], at)]
            self.levels.append(level)

    def pairs(self, num: int, den: int) -> np.ndarray:
        """Rows (i, j, spare overlap) of different components that may link; i and j are positions in the input."""
        found = []
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            depth, x, y = todo.pop()
            level = self.levels[depth]
            if x != y and self._pruned(level, x, y, num, den) or x == y and level[6][x] == level[7][x]:
                continue
            if depth:
                xs, ys = range(level[0][x], level[1][x]), range(level[0][y], level[1][y])
                todo += [(depth - 1, i, j) for i in xs for j in ys if x != y or i <= j]
                continue
            i = np.arange(level[0][x], level[1][x])[:, None]
            j = np.arange(level[0][y], level[1][y])[None, :]
            i, j = (z.ravel() for z in np.broadcast_arrays(i, j))
            ok = (self.label[i] != self.label[j]) & ((i < j) if x == y else True)
            i, j = i[ok], j[ok]
            na, nb = self.n[i], self.n[j]
            ok = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            i, j = i[ok], j[ok]
            if len(i):
                common = np.bitwise_count(self.bits[i] & self.bits[j]).sum(1, dtype=np.int64) + np.minimum(self.spare[i], self.spare[j])
                more = common - required_overlap(self.n[i], self.n[j], num, den)
                ok = more >= 0
                if ok.any():
                    found.append(np.stack([self.order[i[ok]], self.order[j[ok]], more[ok]], 1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    @staticmethod
    def _pruned(level, x: int, y: int, num: int, den: int) -> bool:
        lo, hi = (x, y) if level[3][x] <= level[3][y] else (y, x)
        if level[4][lo] * den < level[3][hi] * num:
            return True
        if level[6][x] == level[7][x] == level[6][y] == level[7][y]:
            return True
        most = int(np.bitwise_count(level[2][x] & level[2][y]).sum()) + min(level[5][x], level[5][y])
        return most < required_overlap(level[3][x], level[3][y], num, den)


#: Groups of more classes get fine bitmaps: with 4 bits for a token the bound lets too many of a large group's pairs through.
LARGE_GROUP = 48
FINE = 8
#: Pairs of any two components that the first pass verifies for each bucket.
LIKELIEST = 2


def bitmap(places: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width // 8, np.uint8)
    at = (places % np.uint64(width)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def width_class(n: int) -> int:
    """Bits of a coarse bitmap: 4 for each token at least, so that few tokens share one; at most 65536."""
    return int(min(65536, max(256, 1 << int(4 * n - 1).bit_length())))


def fold(bits: np.ndarray) -> np.ndarray:
    half = len(bits) // 2
    return bits[:half] | bits[half:]


def _tree_pairs(num: int, den: int, best: int | None):
    """Candidate pairs of a bucket's groups; with ``best``, so many of any two components."""

    def run(group: pa.Table) -> pa.Table:
        token = group.column("token").to_numpy()
        cls = group.column("cls").to_numpy()
        n = group.column("n").to_numpy().astype(np.int64)
        label = group.column("root").to_numpy()
        shared = group.column("shared").to_numpy().astype(np.int64)
        fine = group.column("fine").to_numpy(zero_copy_only=False)
        raw = group.column("bits")
        found: set = set()
        likeliest: dict = {}
        order = np.argsort(token, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(token[order]) != 0]) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            rows = order[a:b]
            maps = {}
            for i in rows.tolist():
                x = raw[i].as_py()
                if fine[i]:
                    maps[i] = bitmap(np.frombuffer(x, np.uint16).astype(np.uint64), min(65536, FINE * width_class(int(n[i]))))
                else:
                    maps[i] = np.frombuffer(x, np.uint8)
            width = np.array([len(maps[i]) for i in rows.tolist()])
            for w in np.unique(width):
                # Sets that may link differ in size by less than 2, so in width by one step at most.
                own, above = rows[width == w], rows[width == 2 * w]
                at = np.r_[own, above]
                if len(at) < 2:
                    continue
                bits = np.stack([maps[i] for i in own.tolist()] + [fold(maps[i]) for i in above.tolist()])
                spare = shared[at] - np.bitwise_count(bits).sum(1, dtype=np.int64)
                for i, j, more in SignatureTree(n[at], bits, spare, label[at]).pairs(num, den).tolist():
                    pair = tuple(sorted((int(cls[at[i]]), int(cls[at[j]]))))
                    if best is None:
                        found.add(pair)
                        continue
                    top = likeliest.setdefault(tuple(sorted((int(label[at[i]]), int(label[at[j]])))), [])
                    if (more, pair) not in top:
                        heapq.heappush(top, (more, pair))
                        if len(top) > best:
                            heapq.heappop(top)
        pairs = sorted(found.union(pair for top in likeliest.values() for _, pair in top))
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("tokens")]
        coarse = [bitmap(t, width_class(k)).tobytes() for t, k in zip(sets, n)]
        fine = [t.astype(np.uint16).tobytes() for t in sets]
        cols = [batch.column("cls"), batch.column("n"), pa.array([len(t) for t in sets], pa.int32()), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["cls", "n", "shared", "coarse", "places"])


def set_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, n, digest) of every row: size and digest of its set of k-word shingles; and rows of frequent tokens (see ``_class_rows``)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    # A separate row id isn't needed: equal rows have equal classes.
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tidy(_class_rows("text", k, to_arrow_type(kind))), f"id {kind.simpleString()}, n long, digest binary, frequent long")


def _deals() -> Column:
    """Keys of the deals an entry goes to, from token, digest, root, major, big and small.

    A group's largest component is cut into ``big`` parts and the rest of it into ``small``
    ones; each part of the first meets each of the second, and those of the second meet
    one another.  So each pair of different components meets, and no deal holds the group.
    """
    part = lambda many: F.pmod(F.xxhash64("cls", F.lit(1)), F.col(many)).cast("int")
    upto = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    across = lambda i, j: F.xxhash64("token", F.lit(0), i, j)
    among = lambda i, j: F.xxhash64("token", F.lit(1), F.least(i, j), F.greatest(i, j))
    others = F.filter(upto("small"), lambda j: j != part("small"))
    return F.when(F.col("root") == F.col("major"), F.transform(upto("small"), lambda j: across(part("big"), j))).otherwise(
        F.concat(F.transform(upto("big"), lambda i: across(i, part("small"))), F.transform(others, lambda j: among(part("small"), j))))


def linked_classes(docs: DataFrame, frequent: np.ndarray, text_col: str, k: int, num: int, den: int, scratch: Scratch, buckets: int | None = None) -> DataFrame:
    """(digest, root): every class that links to another one, and a number that its component shares."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = buckets or partitions(spark)
    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_pack_tokens("text", k, buckets, spark.sparkContext.broadcast(frequent.tobytes()))), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_shared_tokens(buckets), _PACKED)
    # A class has one row here, so from the written table on a number stands for its digest.
    alive = scratch.table(shared.groupBy("bucket").applyInArrow(_prefixes(num, den), _ALIVE).withColumn("cls", F.monotonically_increasing_id()), "alive")

    # The salt divides a frequent token's entries among all tasks; a token has one row at most for each salt where it is looked up.
    salt = F.pmod(F.xxhash64("cls"), F.lit(buckets)).cast("int").alias("salt")
    entries = alive.select(F.explode("prefix").alias("token"), "cls").select("token", "cls", salt)
    parts = entries.groupBy("token", "salt").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    least = parts.groupBy("token").agg(F.min("least").alias("b"), F.max("most").alias("last")).where("b < last").select("token", "b")
    stars = entries.join(parts.select("token", "salt").join(least, "token"), ["token", "salt"]).where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    links = scratch.table(_verified(stars, alive, num, den), "links")
    roots = scratch.table(connected_components(links, scratch), "roots")
    marks = alive.select("cls", "n", "tokens").mapInArrow(tidy(_bitmaps), "cls long, n int, shared int, coarse binary, places binary")

    for best in (LIKELIEST, None):
        labelled = entries.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("token", "salt", "cls", F.coalesce("root", "cls").alias("root"))
        labelled = scratch.table(labelled, "labelled")
        salted = labelled.groupBy("token", "salt", "root").agg(F.count("*").alias("n"))
        by = salted.groupBy("token", "root").agg(F.sum("n").alias("n"))
        mixed = by.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("many"), F.count("*").alias("roots")).where("roots > 1")
        mixed = mixed.select("token", "major", (F.col("many") > LARGE_GROUP).alias("fine"), F.ceil(F.col("most") / GROUP).cast("int").alias("big"), F.ceil((F.col("many") - F.col("most")) / GROUP).cast("int").alias("small"))
        labelled = labelled.join(salted.select("token", "salt").distinct().join(mixed, "token"), ["token", "salt"])
        dealt = labelled.select("cls", "root", "fine", F.explode(_deals()).alias("token"))
        rest = dealt.join(marks, "cls").select("token", "cls", "root", "n", "shared", "fine", F.when(F.col("fine"), F.col("places")).otherwise(F.col("coarse")).alias("bits"),
                                               F.expr(f"pmod(token, {4 * buckets})").alias("bucket"))
        pairs = rest.groupBy("bucket").applyInArrow(_tree_pairs(num, den, best), _CANDIDATES).distinct()
        more = _verified(pairs, alive, num, den)
        lifted = (more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
                  .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
                  .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct())
        above = scratch.table(connected_components(lifted, scratch), "above")
        lift = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
        composed = roots.join(lift, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # classes that only this pass linked aren't among the nodes so far
        roots = scratch.table(composed.union(above.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
    return alive.select(F.col("cls").alias("node"), "digest").join(roots, "node").select("digest", "root")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100,
                       buckets: int | None = None) -> DataFrame:
    """One row for each input row: ``id_col``, ``n_shingles``, ``component_id``.

    Two rows link if ``den * |A & B| >= num * |A | B|`` for their sets of distinct
    ``k``-word shingles of A-Z-lowered words; ``component_id`` is the smallest id that is
    reachable by links.  Rows with fewer than ``k`` words have one shingle of all their
    words; null texts and texts without words have none, link with nothing and keep
    their own id.  Rows with a null id take part; an id is null in the result only if
    all of its component's ids are.  Repeated rows are returned as often as they are
    given.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    scanned = scratch.table(set_classes(docs, id_col, text_col, k), "classes")
    rows = scanned.where("frequent is null")
    nodes = linked_classes(docs, frequent_tokens(scanned, scratch, FREQUENT_MOST), text_col, k, num, den, scratch, buckets)
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"))
    rooted = classes.join(nodes, "digest", "left")
    top = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    named = rooted.join(top, "root", "left").select("digest", F.coalesce("top", "least").alias("component_id"))
    full = rows.where("n > 0").join(named, "digest").select("id", "n", "component_id")
    bare = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(bare).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
