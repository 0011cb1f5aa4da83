"""Periodic runs against a brute-force reading, whole and by ranges of lags."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import queries, run_detection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def brute_runs(w, least=6, exponent=4):
    """Every maximal stretch whose smallest period is short enough, by trying all stretches of each lag."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{l},{q}\n" for s, l, q in runs)), digest(kept))


def texts(seed=3):
    r = random.Random(seed)
    out = ["", None, " \n\t", "a", "a a a a a", "a a a a a a", "é é é é é é é b", "x " * 500, "a b " * 40 + "c", "  a\x0bb a  b"]
    for k in range(150):
        part = []
        while len(part) < r.randint(1, 90):
            block = [r.choice("abcde"[: 1 + k % 5]) for _ in range(r.randint(1, 7))]
            part += block * r.choice((1, 1, 2, 4, 5, 9)) + block[: r.randint(0, len(block))]
        out.append(" ".join(part))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)


def as_rows(df):
    return {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()}


def test_scan_by_brute_force(spark, docs):
    found = as_rows(run_detection.periodic_runs(docs))
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        gone = {k for s, l, q in runs for k in range(s + q, s + l)}
        assert found[i] == (len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)), t


@pytest.mark.parametrize("work", [1, 50])
def test_ranges_of_lags_give_the_same(spark, docs, work):
    whole = as_rows(run_detection.periodic_runs(docs))
    assert as_rows(run_detection.periodic_runs(docs, whole_bytes=1, range_work=work, range_lags=3)) == whole


@pytest.mark.parametrize("exponent, least", [(2, 3), (3, 1), (6, 20)])
def test_other_exponents(spark, docs, exponent, least):
    found = as_rows(run_detection.periodic_runs(docs, min_length=least, min_exponent=exponent))
    assert all(found[i][1] == brute_runs(WORD.findall(t or ""), least, exponent) for i, t in enumerate(texts()))
    with pytest.raises(ValueError):
        run_detection.periodic_runs(docs, min_exponent=1)


def test_query_by_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(9) * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert got == {i: brute_row(i, t) for i, t in rows}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and bool(t) for i, t in rows) > 10


def test_very_long_texts(spark):
    r = random.Random(5)
    w = [r.choice("abcdefgh") for _ in range(60_000)]
    w[20_000:59_000] = (w[20_000:29_000] * 5)[:39_000]
    text = " ".join(w)
    docs = spark.createDataFrame([(1, text), (2, text), (3, "z " * 40_000)], "doc_id long, text string")
    found = as_rows(run_detection.periodic_runs(docs))
    assert found[1] == found[2] and found[3][1] == [(0, 40_000, 1)] and found[3][2] == "z"
    big = [x for x in found[1][1] if x[2] == 9000]
    assert len(big) == 1 and big[0][0] <= 20_000 and big[0][0] + big[0][1] >= 59_000


@pytest.mark.parametrize("whole", [1, run_detection.WHOLE_BYTES])
def test_odd_tables(spark, whole):
    names = ("id", "digest", "low", "high", "runs", "n", "h", "g", "w", "a", "p")
    rows = [(None, "a a a a a a"), (None, "a a a a a a"), (4, "a a a a a a"), (4, "b"), (5, None), (5, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    found = run_detection.periodic_runs(odd, whole_bytes=whole).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs)) for r in found) == [(0, 6, 1), (0, 6, 1), (4, 1, 0), (4, 6, 1), (5, 0, 0), (5, 0, 0)]
    assert run_detection.periodic_runs(odd.where("false"), whole_bytes=whole).count() == 0
    planted = run_detection.crc_repeated(odd)
    assert planted.columns == ["doc_id", "text"] and planted.count() == 6 and planted.where("doc_id is null and text = 'a a a a a a'").count() == 2
    strings = odd.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert run_detection.periodic_runs(strings, whole_bytes=whole).where("doc_id = 'k4'").count() == 2
