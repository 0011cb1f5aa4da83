"""Graph search against brute force: recall, exact scores, order, and vectors that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import graph_search, queries


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(rows, queries_, k):
    out = {}
    for q, v in queries_:
        score = [(-float(np.dot(x, v)), i) for i, x in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def search(spark, rows, asked, k=20, **size):
    index, shards = graph_search.build_index(table(spark, rows), **size)
    found = graph_search.search_index(index, shards, table(spark, asked), k).orderBy("query_id", "rank").collect()
    out = {}
    for r in found:
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, true):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in t}) / len(t) for q, t in true.items()])


def test_table_query(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in t]
    true = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {}
    for r in queries.op12_graph_search(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == true.keys() and all(len(x) == 20 for x in found.values())
    assert recall(found, true) >= 0.97
    known = dict(rows)
    assert all(abs(s - np.dot(known[q], known[i])) < 1e-12 for q, x in found.items() for i, s in x)


@pytest.mark.parametrize("scale", [0, 1.5])
def test_recall_over_shards(spark, scale):
    """Vectors without any structure, of one length and of very different lengths."""
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 24)) * np.exp(scale * r.normal(size=(4000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = rows[::40]
    assert recall(search(spark, rows, asked, shard_rows=1000), brute(rows, asked, 20)) >= 0.95


def test_hot_vector_and_ties(spark):
    r = np.random.default_rng(5)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(r.normal(size=8))
    hot = unit()
    rows = [(i, hot if i % 3 == 0 else unit()) for i in range(2400)]
    found = search(spark, rows, [(0, hot), (60, hot), (1, rows[1][1])], shard_rows=900)
    assert [i for i, _ in found[0]] == list(range(3, 63, 3))
    assert [i for i, _ in found[60]] == [*range(0, 60, 3)]
    assert len({s for _, s in found[0]}) == 1
    assert len(found[1]) == 20


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [1.0, float(i)]) for i in range(7)]
    assert search(spark, rows, rows[:2]) == brute(rows, rows[:2], 20)


def test_unreached_nodes_have_entries():
    """Two far groups, and no edge between them: the entries together reach all."""
    edges = np.array([[1, 4], [0, 4], [3, 4], [2, 4], [4, 4]], np.int32)
    assert graph_search._reach(edges, 4, 1).tolist() == [1, 2]


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5], [0, 0]], np.float32)
    kept = graph_search.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 4, 0, 5]]), 3, 1.2)[0].tolist()
    assert kept[:2] == [1, 3] and 2 not in kept


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [3.0, 2.0, 1.0]), (9, [-0.0, 1.0]), (9, [2.0, 1.0])]
    odd = table(spark, rows).withColumns({c: F.lit(7) for c in ("id", "v", "dim", "shard", "block", "class", "rank", "score")})
    index, shards = graph_search.build_index(odd)
    found = graph_search.search_index(index, shards, odd, 5)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 2.0), (0, 2, 1, 0.5), (1, 1, 9, 1.5), (1, 2, 0, 0.5), (8, 1, 20, 10.0), (9, 1, 1, 0.5), (9, 2, 0, 0.0), (20, 1, 8, 10.0)]
    none, shards = graph_search.build_index(odd.where("false"))
    assert graph_search.search_index(none, shards, odd).count() == 0
    assert graph_search.search_index(index, shards, odd.where("false")).count() == 0
