"""Communities, components and eigenvectors by joins, against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import communities, graph, ordering

EDGES = "src string, dst string, phi double"


def brute_modularity(edges, label):
    total, inside, every = 0.0, {}, {}
    for a, b, w in [*edges, *[(b, a, w) for a, b, w in edges]]:
        if a != b and w is not None:
            total += w
            every[label[a]] = every.get(label[a], 0) + w
            if label[a] == label[b]:
                inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / total - (t / total) ** 2 for c, t in every.items())


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def found(df):
    return {r.id: r.community for r in df.collect()}


def test_planted_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i, j in itertools.combinations(range(5), 2)]
    edges += [("a0", "b0", 0.5), ("b1", "c1", 0.5), ("c2", "a2", -0.3), ("d0", "d1", 1.0), ("a1", "a1", 9.0), ("a0", "c0", None)]
    got = found(communities.louvain(spark.createDataFrame(edges, EDGES)))
    assert got == {**{f"{g}{i}": n + 1 for n, g in enumerate("abc") for i in range(5)}, "d0": 4, "d1": 4}


@pytest.mark.parametrize("seed", [1, 2])
def test_close_to_the_best_partition(spark, seed):
    r = random.Random(seed)
    names = list("pqrstuvw")
    edges = [(a, b, r.uniform(0.05, 1) if (names.index(a) < 4) == (names.index(b) < 4) else r.uniform(-0.1, 0.3)) for a, b in itertools.combinations(names, 2) if r.random() < 0.8]
    df = spark.createDataFrame(edges, EDGES)
    got = found(communities.louvain(df))
    value = brute_modularity(edges, got)
    best = max(brute_modularity(edges, {x: i for i, part in enumerate(p) for x in part}) for p in partitions(names))
    assert value >= 0.9 * best and value > 0
    labels = spark.createDataFrame(list(got.items()), "id string, community int")
    assert abs(communities.modularity(df, labels).first()[0] - value) < 1e-9


def test_no_positive_weight_and_no_edges(spark):
    assert found(communities.louvain(spark.createDataFrame([("a", "b", -1.0), ("b", "c", 0.5)], EDGES))) == {"a": 1, "b": 2, "c": 3}
    none = spark.createDataFrame([], EDGES)
    assert communities.louvain(none).count() == communities.components(none).count() == graph.eigenvector_centrality(none).count() == 0


def test_components_of_long_chains(spark):
    r = random.Random(3)
    chain = [f"n{i:03d}" for i in range(60)]
    r.shuffle(chain)
    edges = [*zip(chain, chain[1:]), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    got = {x.id: x.component for x in communities.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{n: "n000" for n in chain}, "x": "x", "y": "x", "z": "x"}


def test_eigenvectors_by_arrays_joins_and_numpy(spark):
    r = random.Random(4)
    names = [f"v{i}" for i in range(12)]
    pairs = [p for p in itertools.combinations(names, 2) if r.random() < 0.4] + [(a, b) for a, b in zip(names, names[1:])]
    a = np.eye(12)
    for x, y in pairs:
        a[names.index(x), names.index(y)] = a[names.index(y), names.index(x)] = 1
    value, vector = np.linalg.eigh(a)
    want = dict(zip(names, np.abs(vector[:, -1])))
    df = spark.createDataFrame(pairs, "src string, dst string")
    for few in (graph.FEW_EDGES, 0):
        got = {x.id: x.eigenvector for x in graph.eigenvector_centrality(df, few=few).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_numbering_in_parts(spark, monkeypatch):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("x"), F.lit("k").alias("other"))
    for few in (1 << 18, 10):
        monkeypatch.setattr(ordering, "ONE_TASK", few)
        assert {(r.x, r.n) for r in ordering.numbered(df, ["x"], "n").collect()} == {(i, i + 1) for i in range(50)}
