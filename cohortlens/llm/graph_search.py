"""Nearest vectors by inner product, from robust-pruned directed graphs.

Vectors are dealt by a hash of id and components into shards of about ``SHARD_ROWS``.
The directions of each shard's distinct vectors become a directed graph: they are inserted
in batches that double in size, a greedy beam search in the graph so far proposes neighbours (all nodes
that it expanded), and relaxed pruning keeps diverse ones: the nearest candidate c stays,
and those go that c is nearer to, by a factor ``ALPHA``, than the node is.  Edges are
returned, and a node whose list grows over ``DEGREE`` is pruned again.  The entry is the
direction nearest to the mean; what it can't reach gets an entry of its own.

A query walks each shard with a beam: the node of largest inner product not expanded yet
hands in its neighbours, until all nodes in the beam are expanded.  What the beams hold is
scored in double precision on the original components, and the best k of all shards are
kept.  Edges join near directions, whatever the vectors' lengths, while the walk weighs
both: with edges by distance, long vectors draw all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch, prepare

#: Vectors of a shard, queries searched at once, edges of a node.
SHARD_ROWS, BLOCK_ROWS, DEGREE = 4096, 2048, 32
#: Width of the beam while building and searching; factor of the pruning.
BUILD_BEAM, BEAM, ALPHA = 64, 128, 1.2
#: A shard of no more distinct vectors is scored whole: a beam would hold most of it.
SMALL = 256
_BATCH = 256


def beam_search(edges: np.ndarray, x: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, expanded ids) of each query's beam, largest inner product first; n stands for no node.

    ``x`` has n + 1 rows and ``edges`` refer to them.
    """
    n, many = len(x) - 1, len(queries)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True
    seen[:, entries] = True
    start = -queries @ x[entries].T
    order = np.argsort(start, 1, kind="stable")[:, :width]
    ids = np.full((many, width), n, np.int32)
    dist = np.full((many, width), np.inf, np.float32)
    ids[:, : order.shape[1]] = entries[order]
    dist[:, : order.shape[1]] = np.take_along_axis(start, order, 1)
    done = ids == n
    walked = []
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            break
        at = (~done[live]).argmax(1)
        here = ids[live, at]
        done[live, at] = True
        step = np.full(many, n, np.int32)
        step[live] = here
        walked.append(step)
        near = edges[here]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = -np.matmul(x[near], queries[live][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        every = np.concatenate([dist[live], d], 1)
        top = np.argsort(every, 1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(every, top, 1)
        ids[live] = np.where(np.isinf(dist[live]), n, np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1))
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), top, 1) | (ids[live] == n)
    return ids, np.stack(walked, 1) if walked else np.full((many, 0), n, np.int32)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among its row of candidates (n: none; repeated ones count once)."""
    n = len(x) - 1
    out = np.full((len(nodes), degree), n, np.int32)
    width = max(1, candidates.shape[1])
    at_once = max(1, (1 << 22) // (width * max(width, x.shape[1])))
    for i in range(0, len(nodes), at_once):
        c, p = np.sort(candidates[i : i + at_once], 1), nodes[i : i + at_once]
        c[:, 1:][c[:, 1:] == c[:, :-1]] = n
        c[c == p[:, None]] = n
        d = ((x[c] - x[p][:, None, :]) ** 2).sum(2)
        d[c == n] = np.inf
        order = np.argsort(d, 1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[c]
        sq = (v * v).sum(2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(d)
        rows = np.arange(len(c))
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            out[i + rows[some], k] = c[rows[some], first[some]]
            alive &= alpha * alpha * between[rows, first] > d
            alive[rows, first] = False
    return out


def _reach(edges: np.ndarray, n: int, entry: int) -> np.ndarray:
    """Entries from which all nodes are reached: the given one, then the first that none before it reaches."""
    entries, seen = [entry], np.zeros(n + 1, bool)
    seen[n] = True
    front = np.array([entry])
    seen[entry] = True
    while True:
        while len(front):
            front = np.unique(edges[front])
            front = front[~seen[front]]
            seen[front] = True
        left = np.flatnonzero(~seen)
        if not len(left):
            return np.array(entries, np.int32)
        entries.append(int(left[0]))
        front = left[:1]
        seen[front] = True


def flat(x: np.ndarray) -> np.ndarray:
    """In single precision, with a row of zeros at the end."""
    return np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of the graph of n directions, given as by ``flat``: edges has n + 1 rows, n stands for no edge."""
    n = len(x) - 1
    edges = np.full((n + 1, degree), n, np.int32)
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    entry = int(((x[:n] - x[:n].mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + min(at, _BATCH)]
        _, walked = beam_search(edges, x, x[batch], np.array([entry], np.int32), beam)
        edges[batch] = robust_prune(x, batch, np.concatenate([walked, edges[batch]], 1), degree, alpha)
        # The edges back: a target's new sources, as a row of candidates beside those it has.
        target, source = edges[batch].ravel(), np.repeat(batch, degree)
        source, target = source[target < n], target[target < n]
        by = np.lexsort((source, target))
        source, target = source[by], target[by]
        ids, first, many = np.unique(target, return_index=True, return_counts=True)
        for few in (True, False):  # hubs apart, so that the others' rows stay short
            some = np.flatnonzero((many <= degree) == few)
            if not len(some):
                continue
            width = int(many[some].max())
            place = first[some][:, None] + np.arange(width)
            new = np.where(np.arange(width) < many[some][:, None], source[np.minimum(place, len(source) - 1)], n)
            every = np.sort(np.concatenate([edges[ids[some]], new.astype(np.int32)], 1), 1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = n
            every.sort(1)
            over = (every < n).sum(1) > degree
            fit = every[~over, :degree]
            edges[ids[some][~over], : fit.shape[1]] = fit
            if over.any():
                edges[ids[some][over]] = robust_prune(x, ids[some][over], every[over], degree, alpha)
        at += len(batch)
    return edges, _reach(edges, n, entry)


_INDEX = "dim int, shard int, ids array<long>, class array<int>, vectors binary, edges binary, entries array<int>"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> tuple[DataFrame, int]:
    """(index, shards): a row for each shard, written in the shared folder, with its ids, distinct vectors and graph.

    Null, empty and zero vectors, those with null or non-finite components and those of a
    null id take no part; equal rows count once; other columns are ignored.  Vectors of
    different lengths are in different shards.  No table, no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "graphs")
    rows = scratch.table(usable(vectors, id_col, vec_col), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        distinct, own = np.unique(x, axis=0, return_inverse=True)
        own = own.reshape(-1)
        order = np.lexsort((ids, own))
        edges, entries = build_graph(flat(directions(distinct)), degree) if len(distinct) > SMALL else (np.zeros((0, degree), np.int32), np.zeros(0, np.int32))
        cols = [pa.array([x.shape[1]], pa.int32()), pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([ids[order].tolist()], pa.list_(pa.int64())), pa.array([own[order].tolist()], pa.list_(pa.int32())),
                pa.array([distinct.tobytes()], pa.binary()), pa.array([edges.tobytes()], pa.binary()), pa.array([entries.tolist()], pa.list_(pa.int32()))]
        return pa.table(cols, names=["dim", "shard", "ids", "class", "vectors", "edges", "entries"])

    return scratch.table(dealt.groupBy("dim", "shard").applyInArrow(build, _INDEX), "index"), shards


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, v) of the vectors that take part, as doubles (zeros have no sign)."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()


def search_shard(index: dict, queries: np.ndarray, own: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of one shard for each query, its own id left out."""
    x = np.frombuffer(index["vectors"]).reshape(-1, index["dim"])
    ids, cls = np.array(index["ids"], np.int64), np.array(index["class"], np.int64)
    first = np.searchsorted(cls, np.arange(len(x) + 1))  # ids are in order of their class
    if index["entries"]:
        # a common scale, and the query's own, change no order
        walk, q = flat(x / np.abs(x).max()), directions(queries).astype(np.float32)
        edges = np.frombuffer(index["edges"], np.int32).reshape(len(x) + 1, -1)
        found = beam_search(edges, walk, q, np.array(index["entries"], np.int32), max(beam, k + 1))[0]
    else:
        found = np.tile(np.arange(len(x), dtype=np.int32), (len(queries), 1))
    for i in range(len(queries)):
        some = found[i][found[i] < len(x)]
        score = (x[some] * queries[i]).sum(1)
        # a class has its k + 1 smallest ids at most: one of them may be the query's own
        last = np.minimum(first[some + 1], first[some] + k + 1)
        many = last - first[some]
        at = np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
        member, value = ids[at], np.repeat(score, many)
        ok = member != own[i]
        member, value = member[ok], value[ok]
        best = np.lexsort((member, -value))[:k]
        yield i, member[best], value[best]


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the index, rows of its own id left out, ties to the smaller id.

    Every query walks every shard of its length, in blocks of about ``block_rows``.
    Unusable queries (see ``build_index``) give no rows; of rows that share an id the one
    with the least vector asks.
    """
    spark = queries.sparkSession
    prepare(spark)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    asked = Scratch(spark, "queries").table(asked, "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if left.num_rows and right.num_rows:
            own = right.column("id").to_numpy()
            q = np.array(right.column("v").combine_chunks().flatten()).reshape(len(own), -1)
            out += [(np.full(len(m), own[i]), m, s) for i, m, s in search_shard(left.drop_columns(["block"]).to_pylist()[0], q, own, k, beam)]
        return pa.table([np.concatenate([x[c] for x in out]) for c in range(3)], names=["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    # An id may have several vectors: its best one counts.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
