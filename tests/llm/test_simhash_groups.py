"""Block tables at the shipped radius: every way of dealing them finds the same pairs as brute force."""

import random

import pytest

from cohortlens.llm import simhash


def prints(seed=11):
    """Random ones, near ones at up to a few bits over the radius, and many that share their first 32 bits."""
    r = random.Random(seed)
    base = [r.getrandbits(128) for _ in range(12)]
    flip = lambda b, n: b ^ sum(1 << k for k in r.sample(range(128), n))
    near = [flip(b, r.randint(0, simhash.RADIUS + 4)) for b in base for _ in range(14)]
    head = r.getrandbits(32) << 96
    return sorted({f"{x:032x}" for x in [*near, *[r.getrandbits(128) for _ in range(150)], *[head | r.getrandbits(96) for _ in range(120)]]})


@pytest.mark.parametrize("group, most", [(1 << 14, 1 << 20), (16, 1 << 20), (64, 20), (1, 7)])
def test_shipped_radius_by_brute_force(spark, monkeypatch, group, most):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group)
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    monkeypatch.setattr(simhash, "LEAST_BITS", 0)
    monkeypatch.setattr(simhash, "MOST_BITS", 6)
    all_ = prints()
    asked = all_[::9]
    df, some = (spark.createDataFrame([(p,) for p in x] + [(None,)], "fingerprint string") for x in (all_, asked))
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {(q, p): d for q in asked for p in all_ if (d := distance(q, p)) <= simhash.RADIUS}
    found = [(x.query, x.fingerprint, x.distance) for x in simhash.near_fingerprints(df, some).collect()]
    assert len(found) == len(want) and {x[:2]: x[2] for x in found} == want
    many = {x.query: x.found for x in simhash.near_counts(df.union(df), some).collect()}
    assert many == {q: 2 * sum(k[0] == q for k in want) for q in asked}
    assert any(simhash.RADIUS - 3 < d for d in want.values())


def test_empty_sides(spark):
    df = spark.createDataFrame([(p,) for p in prints()[:5]], "fingerprint string")
    for a, b in ((df, df.where("false")), (df.where("false"), df)):
        assert simhash.near_fingerprints(a, b).count() == simhash.near_counts(a, b).count() == 0
