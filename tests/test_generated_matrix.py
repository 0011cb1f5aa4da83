"""A generated matrix of 91 isolates, 13 drugs and 21 genes against plain Python."""

import math
import random
from collections import Counter, defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import advanced, graph, mining, ordering, pairs, resistance
from cohortlens.sources.matrix import DRUG_CLASSES, BinaryMatrix, feature_roles, from_wide

GENES = ["SAT-4", "aad9", "ant(6)-Ia", "aph(3')-III", "erm(47)", "erm(B)", "lnu(B)", "lnu(C)", "lsa(E)", "optrA", "spw", "tet(40)", "tet(44)", "tet(L)", "tet(M)", "tet(O)", "tet(O/W/32/O)", "tet(T)", "tet(W)", "vga(F)", "cfr"]
DRUGS = [d for c in DRUG_CLASSES.values() for d in c]
NAMES = DRUGS + GENES


def generated() -> dict[str, list[int]]:
    r = random.Random(5)
    share = {n: 0.0 if n == "Amoxicillin_Clavulanic_acid" else r.choice((0.03, 0.2, 0.4, 0.7)) for n in NAMES}
    rows = {}
    for i in range(91):
        row = {n: int(r.random() < share[n]) for n in NAMES}
        for drug, gene in zip(DRUGS[:6], GENES[3:9]):  # tied pairs
            if r.random() < 0.7:
                row[gene] = row[drug]
        rows[f"s{i:02d}"] = [row[n] for n in NAMES]
    return rows


ROWS = generated()
COLUMNS = {n: [row[j] for row in ROWS.values()] for j, n in enumerate(NAMES)}


@pytest.fixture(scope="module")
def m(spark):
    wide = spark.createDataFrame([(k, *v) for k, v in ROWS.items()], "Strain_ID string, " + ", ".join(f"`{n}` int" for n in NAMES))
    got = from_wide(wide)
    return BinaryMatrix(got.ones.cache(), got.rows.cache(), got.features)


def table(x, y):
    c = Counter(zip(x, y))
    return c[0, 0], c[0, 1], c[1, 0], c[1, 1]


def slow_test(a, b, c, d):
    """(p, phi) by the rule: Fisher where an expected count is below 5, else Yates."""
    n, r, k = a + b + c + d, c + d, b + d
    if not 0 < r < n or not 0 < k < n:
        return None
    expected = [(n - r) * (n - k) / n, (n - r) * k / n, r * (n - k) / n, r * k / n]
    phi = (a * d - b * c) / math.sqrt((n - r) * r * (n - k) * k)
    if min(expected) < 5:
        chance = [math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, r + k - n), min(r, k) + 1)]
        seen = chance[d - max(0, r + k - n)]
        return min(1, sum(x for x in chance if x <= seen * (1 + 1e-7))), phi
    chi2 = sum((abs(o - e) - min(0.5, abs(o - e))) ** 2 / e for o, e in zip((a, b, c, d), expected))
    return math.erfc(math.sqrt(chi2 / 2)), phi


def slow_pairs(names):
    """BH-adjusted tests of all pairs of columns."""
    found = [(x, y, *t) for x, y in combinations(names, 2) if (t := slow_test(*table(COLUMNS[x], COLUMNS[y])))]
    found.sort(key=lambda t: (t[2], t[0], t[1]))
    out, least = {}, 1.0
    for rank in range(len(found), 0, -1):
        x, y, p, phi = found[rank - 1]
        least = min(least, p * len(found) / rank)
        out[x, y] = (least, phi)
    return out


def test_roles_and_classes(m):
    assert [(r[0], r[1]) for r in feature_roles(["Strain_ID", *NAMES])] == [(n, "phenotype" if n in DRUGS else "gene") for n in NAMES]
    classes = {k: sum(any(v[NAMES.index(d)] for d in ds) for ds in DRUG_CLASSES.values()) for k, v in ROWS.items()}
    assert {r.row: (r.n_classes, r.is_mdr) for r in resistance.multiresistance(m).collect()} == {k: (n, n >= 3) for k, n in classes.items()}
    freq = {r.pattern: r.n for r in mining.pattern_frequencies(mining.patterns(m.class_level())).collect()}
    assert freq == Counter(", ".join(sorted(c for c, ds in DRUG_CLASSES.items() if any(v[NAMES.index(d)] for d in ds))) or "No_Resistance" for v in ROWS.values())


def test_pairs_and_network(m):
    want = {k: v for k, v in slow_pairs(NAMES).items() if v[0] <= 0.05}
    assert len(want) >= 5
    got = {(r.item1, r.item2): r for r in pairs.cooccurrence(m).collect()}
    assert set(got) == set(want) and all(got[k].adj_p == pytest.approx(p) and got[k].phi == pytest.approx(phi) for k, (p, phi) in want.items())
    edges = graph.network_edges(m)
    near = defaultdict(set)
    for x, y in want:
        near[x].add(y)
        near[y].add(x)
    score = Counter()
    for s in near:  # Brandes
        order, before, paths, far = [], defaultdict(list), Counter({s: 1}), {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(near[v]):
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        part = Counter()
        for w in reversed(order):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                score[w] += part[w]
    n = len(near)
    found = {r.id: r.betweenness for r in graph.betweenness(graph.shortest_paths(edges)).collect()}
    assert found == pytest.approx({v: score[v] / ((n - 1) * (n - 2)) for v in near})


def test_itemsets(m):
    has = [frozenset(n for n, x in zip(NAMES, v) if x and n in GENES) for v in ROWS.values()]
    want, level = {}, [(g,) for g in sorted(GENES)]
    while level:
        level = [c for c in level if sum(set(c) <= h for h in has) >= 0.2 * 91]
        want |= {c: sum(set(c) <= h for h in has) for c in level}
        level = [(*c, g) for c in level for g in sorted(GENES) if g > c[-1]]
    assert {tuple(r["items"]): r.n for r in mining.frequent_itemsets(m.role("gene"), 0.2).collect()} == want


def test_ordered_patterns(m):
    genes = m.role("gene")
    strong = {(x, y) for a, b in combinations(GENES, 2) if (t := slow_test(*table(COLUMNS[a], COLUMNS[b]))) and t[1] > 0.3 for x, y in ((a, b), (b, a))}
    tables = mining.pair_tables(genes)
    assert {(r.a, r.b) for r in mining.directed_edges(tables).collect()} == strong
    for r in mining.ordered_triplets(genes, 0.0, 0.0, 0.1, tables=tables).collect():
        a, b, c = (COLUMNS[x] for x in r.path)
        assert r.support == pytest.approx(sum(map(all, zip(a, b, c))) / 91)
        assert r.confidence == pytest.approx(sum(map(all, zip(a, b))) / sum(a) * sum(map(all, zip(b, c))) / sum(b))


def test_ranks_in_parts(spark, monkeypatch):
    """The way for large tables gives what one window gives."""
    r = random.Random(1)
    rows = [(i, r.choice("xyz"), r.choice((None, *range(40)))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(3)
    tests = spark.createDataFrame([(f"a{i}", f"b{i}", r.choice((0.001, 0.01, 0.02, 0.2, r.random()))) for i in range(200)], "item1 string, item2 string, p double")

    def results():
        return ({x.id: x.percentile_rank for x in ordering.percentile_rank(df, "v").collect()}, {x.g: (x.a, x.b) for x in ordering.quantiles(df, "v", {"a": 0.25, "b": 0.9}, ("g",)).collect()},
                ordering.quantiles(df, "v", {"q": 0.75}).first().q, [{x.item1: x.adj_p for x in pairs.adjust(tests, method=k).collect()} for k in ("fdr_bh", "holm", "bonferroni")])

    one = results()
    monkeypatch.setattr(ordering, "ONE_TASK", 10)
    several = results()
    assert several[:3] == one[:3] and all(x == pytest.approx(y) for x, y in zip(several[3], one[3]))
    values = sorted(x for _, _, x in rows if x is not None)
    place = (len(values) - 1) * 0.75
    low = math.floor(place)
    assert one[2] == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low))
    assert df.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("b")).collect() and {x.g: x.b for x in df.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("b")).collect()} == pytest.approx({g: b for g, (_, b) in one[1].items()})


def test_ranks_of_values_that_fill_parts(spark, monkeypatch):
    """Half of the rows share a value, which lies in several parts; nulls do, too."""
    r = random.Random(2)
    rows = [(i, 5.0 if r.random() < 0.5 else None if r.random() < 0.3 else float(r.randrange(12))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(3)
    monkeypatch.setattr(ordering, "ONE_TASK", 10)
    monkeypatch.setattr(ordering, "in_parts", lambda df, order, known=ordering.in_parts: parts.append(known(df, order)) or parts[-1])
    parts = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.id: x for x in ordering.placed(df, "v").collect()}
        assert parts[0][1] and parts[0][0].where("v = 5").select("_part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    times = Counter(v for _, v in rows)
    below = {v: sum(k for x, k in times.items() if v is not None and (x is None or x < v)) for v in times}
    assert len(got) == 3000 and all((got[i]._below, got[i]._c, got[i]._n) == (below[v], times[v], 3000) for i, v in rows)
    empty = spark.createDataFrame([], "id int, v double")
    assert ordering.percentile_rank(empty, "v").count() == 0
    extremes = spark.createDataFrame([(1, float("nan")), (2, -0.0), (3, 0.0), (4, None)], "id int, v double")
    assert {x.id: x.percentile_rank for x in ordering.percentile_rank(extremes, "v").collect()} == {4: 25.0, 2: 62.5, 3: 62.5, 1: 100.0}


def test_rules_in_blocks_of_sets(m, monkeypatch):
    """However few sets a task holds, the limits are the same."""
    def found():
        return {(tuple(r.antecedents), tuple(r.consequents)): (r.lift_ci_lower, r.lift_ci_upper) for r in advanced.rules_with_intervals(m.role("gene"), 0.3, 0.4, 40).collect()}

    whole = found()
    monkeypatch.setattr(advanced, "SETS_BYTES", 40)
    assert len(whole) > 4 and found() == whole
