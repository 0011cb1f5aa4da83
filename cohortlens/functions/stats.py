"""Statistics of 2x2 tables as Spark column expressions.

A table is four counts a, b, c, d = n00, n01, n10, n11.  Everything runs in the JVM;
nothing here is a Python function of rows.  Undefined results are null, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ln k! below this is a constant; above, Stirling's series is exact to double precision.
_SMALL = 32
_SQRT_PI = math.sqrt(math.pi)


def ln_factorial(k: Column) -> Column:
    # a folded constant: one node of the plan, however often it is used
    table = F.split(F.lit(",".join(repr(math.lgamma(i + 1)) for i in range(_SMALL))), ",").cast("array<double>")
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(k < _SMALL, F.element_at(table, k.cast("int") + 1)).otherwise(series)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times: a lambda over an array of one element keeps the plan from repeating it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a positive series below 2.5, a continued fraction above."""
    return bind(z, _erfc)


def _erfc(z: Column) -> Column:
    z2 = z * z
    start = F.struct(z.alias("term"), z.alias("total"))

    def more(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * z2 / (2 * n + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = 1 - 2 / _SQRT_PI * F.exp(-z2) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, more, lambda s: s["total"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda t, k: z + (k / 2) / t)
    return F.when(z < 2.5, F.greatest(series, F.lit(0.0))).otherwise(F.exp(-z2) / (_SQRT_PI * fraction))


def chi2_p(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2))


def phi(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(ad - bc) / sqrt of the product of the margins; null if a margin is 0."""
    product = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.when(product > 0, (a.cast("double") * d - b.cast("double") * c) / F.sqrt(product))


def _cells(a, b, c, d):
    n = F.nullif((a + b + c + d).cast("double"), F.lit(0.0))
    return [(o, r.cast("double") * k / n) for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))]


def least_expected(a, b, c, d) -> Column:
    return F.least(*[e for _, e in _cells(a, b, c, d)])


def yates_chi2(a, b, c, d) -> Column:
    return sum((F.pow(F.abs(o - e) - F.least(F.lit(0.5), F.abs(o - e)), 2) / e for o, e in _cells(a, b, c, d)), F.lit(0.0))


def plain_chi2(a, b, c, d) -> Column:
    """Uncorrected chi-square; 0 for tables with an empty margin or a negative count."""
    n = (a + b + c + d).cast("double")
    product = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    det = a.cast("double") * d - b.cast("double") * c
    return F.when((F.least(a, b, c, d) >= 0) & (product > 0), n * det * det / product).otherwise(0.0)


def _ln_pmf(x: Column, r: Column, k: Column, n: Column) -> Column:
    """Log of the chance of x joint ones, given margins r and k of n."""
    ln = ln_factorial
    return ln(r) + ln(n - r) + ln(k) + ln(n - k) - ln(n) - ln(x) - ln(r - x) - ln(k - x) - ln(n - r - k + x)


#: Tables of a margin's support that are all visited; a longer support is summed where its chances count.
WHOLE_SUPPORT = 512
#: Steps from where a tail begins: at so many deviations (and a few for small means) the chances have fallen below double precision.
_DEVIATIONS, _MORE_STEPS = 9, 80


def _stirling_rest(k: Column) -> Column:
    """ln k! less Stirling's formula."""
    rest = [0.0] + [math.lgamma(i + 1) - (0.5 * math.log(2 * math.pi * i) + i * math.log(i) - i) for i in range(1, _SMALL)]
    table, x = F.split(F.lit(",".join(map(repr, rest))), ",").cast("array<double>"), k.cast("double")
    return F.when(k < _SMALL, F.element_at(table, k.cast("int") + 1)).otherwise(1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7))


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where the two are near each other and the terms would cancel."""

    def near(v: Column) -> Column:
        def series(v2: Column) -> Column:
            total = F.lit(1 / 21)
            for odd in range(19, 1, -2):
                total = total * v2 + 1 / odd
            return (x - mean) * v + 2 * x * v * v2 * total

        return bind(v * v, series)

    return F.when(F.abs(x - mean) < 0.1 * (x + mean), bind((x - mean) / (x + mean), near)).otherwise(x * F.log(x / mean) + mean - x)


def _signed_sum(terms: list[tuple[Column, ...]], body: Callable[[Column], Column]) -> Column:
    """Sum of ``sign`` times body over structs (sign, a, b); the body is in the plan once."""
    each = F.array(*[F.struct(F.lit(float(s)).alias("sign"), a.cast("double").alias("a"), b.cast("double").alias("b")) for s, a, b in terms])
    return F.aggregate(each, F.lit(0.0), lambda t, s: t + s["sign"] * body(s))


def _ln_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """Log of a binomial chance from deviances, which stay small where factorials' logs are of the size of n."""
    rest = _signed_sum([(1, n, n), (-1, x, x), (-1, n - x, n)], lambda s: _stirling_rest(s["a"]))
    apart = _signed_sum([(1, x, n * p), (1, n - x, n * q)], lambda s: _deviance(s["a"], s["b"]))
    end = bind(F.when(x == 0, q).otherwise(p), lambda base: F.when(n == 0, 0.0).otherwise(n * F.when(base > 0.5, F.log1p(-F.when(x == 0, p).otherwise(q))).otherwise(F.log(base))))
    return F.when((x == 0) | (x == n), end).otherwise(rest - apart + 0.5 * F.log(n / (2 * math.pi * x * (n - x))))


def _ln_pmf_wide(x: Column, m: Column) -> Column:
    """``_ln_pmf`` of any margins to double precision, as a quotient of binomial chances."""
    return _signed_sum([(1, x, m["r"]), (1, m["k"] - x, m["n"] - m["r"]), (-1, m["k"], m["n"])], lambda s: _ln_binomial(s["a"], s["b"], m["p"], m["q"]))


def _outward(m: Column, start: Column, up: bool) -> Column:
    """Sum of the chances from a table on, away from the mode, over that table's own chance."""
    room = (F.least(m["r"], m["k"]) - start) if up else (start - m["low"])
    steps = F.least(room, F.ceil(_DEVIATIONS * m["sd"]).cast("long") + _MORE_STEPS)

    def add(s: Column, i: Column) -> Column:
        x = (start + i if up else start - i).cast("double")
        rest = m["n"] - m["r"] - m["k"]
        ratio = (m["r"] - x) * (m["k"] - x) / ((x + 1) * (rest + x + 1)) if up else x * (rest + x) / ((m["r"] - x + 1) * (m["k"] - x + 1))
        return F.struct((s["term"] * ratio).alias("term"), (s["sum"] + s["term"]).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"])


def _last(low: Column, high: Column, value: Callable[[Column], Column], limit: Column) -> Column:
    """(x, value) of the largest x of low..high whose value, which grows with x, is within the limit; x = low - 1 if none is."""
    begin = F.struct((low - 1).alias("x"), F.lit(None).cast("double").alias("value"), (high + 1).alias("no"))

    def halve(s: Column, _: Column) -> Column:
        def look(mid: Column) -> Column:
            return bind(value(mid), lambda v: F.when(v <= limit, F.struct(mid.alias("x"), v.alias("value"), s["no"].alias("no"))).otherwise(F.struct(s["x"].alias("x"), s["value"].alias("value"), mid.alias("no"))))

        return F.when(s["no"] - s["x"] <= 1, s).otherwise(bind(F.floor((s["x"] + s["no"]) / 2).cast("long"), look))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), begin, halve)


def _margins(a: Column, b: Column, c: Column, d: Column) -> Column:
    long = lambda x: x.cast("long")
    r, k, n = long(c + d), long(b + d), long(a + b + c + d)
    return F.struct(r.alias("r"), k.alias("k"), n.alias("n"), long(d).alias("d"), F.floor((r + 1).cast("double") * (k + 1) / (n + 2)).cast("long").alias("mode"))


def _oriented(v: Column, turned: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the margins, or of the table with its columns swapped (x becomes r - x)."""
    turn = F.struct(v["r"].alias("r"), F.when(turned, v["n"] - v["k"]).otherwise(v["k"]).alias("k"), v["n"].alias("n"), F.when(turned, v["r"] - v["d"]).otherwise(v["d"]).alias("d"), turned.alias("turned"))
    real = lambda x: x.cast("double")

    def whole(m: Column) -> Column:
        r, k, n = m["r"], m["k"], m["n"]
        sd = F.sqrt(real(r) / n * k / n * (n - r) * real(n - k) / F.greatest(n - 1, F.lit(1)))
        return F.struct(*[m[c].alias(c) for c in ("r", "k", "n", "d", "turned")], F.greatest(F.lit(0).cast("long"), r + k - n).alias("low"), sd.alias("sd"), (real(k) / n).alias("p"), (real(n - k) / n).alias("q"),
                        F.floor(real(r + 1) * (k + 1) / (n + 2)).cast("long").alias("mode"))

    return bind(bind(turn, whole), body)


def _fisher_wide(v: Column) -> Column:
    """Both tails: from the table seen outwards, and from the first table of the other side that is no likelier.

    A table seen below the mode is turned round first, so that its own tail is the upper one.
    """

    def both(m: Column) -> Column:
        def tails(seen: Column) -> Column:
            other = _last(m["low"], F.least(m["mode"], m["d"] - 1), lambda x: _ln_pmf_wide(x, m), seen + 1e-7)
            lower = bind(other, lambda s: F.when(s["x"] >= m["low"], F.exp(s["value"]) * _outward(m, s["x"], False)).otherwise(0.0))
            return F.least(F.lit(1.0), F.exp(seen) * _outward(m, m["d"], True) + lower)

        return bind(_ln_pmf_wide(m["d"], m), tails)

    return _oriented(v, v["d"] < v["mode"], both)


def _upper_wide(v: Column) -> Column:
    """From the table seen on; at the mode or below it as what the lower tail leaves, so that no sum runs through the mode.

    The lower tail, up to d - 1, is the upper one of the table turned round, from r - d + 1 on.
    """

    def tail(m: Column) -> Column:
        start = F.when(m["turned"], m["d"] + 1).otherwise(m["d"])
        found = bind(start, lambda x: F.when(x > F.least(m["r"], m["k"]), 0.0).otherwise(F.exp(_ln_pmf_wide(x, m)) * _outward(m, x, True)))
        return bind(found, lambda p: F.least(F.lit(1.0), F.when(m["turned"], 1 - p).otherwise(p)))

    return _oriented(v, v["d"] <= v["mode"], tail)


def _tail(a, b, c, d, keep, start: Column | None = None) -> Column:
    """Sum of the chances of the tables that ``keep`` takes, from the start (the least possible) on.

    Each step adds the logarithm of the ratio of neighbouring chances, so factorials
    are needed for the first table and the one seen only.
    """
    margins = F.struct((c + d).alias("r"), (b + d).alias("k"), (a + b + c + d).alias("n"), d.alias("d"))

    def bound(m: Column) -> Column:
        low = F.greatest(F.lit(0), m["r"] + m["k"] - m["n"]) if start is None else m["d"]
        first = _ln_pmf(low, m["r"], m["k"], m["n"])
        return F.struct(m["r"].alias("r"), m["k"].alias("k"), m["n"].alias("n"), low.alias("low"), first.alias("first"),
                        (first if start is not None else _ln_pmf(m["d"], m["r"], m["k"], m["n"])).alias("seen"))

    def total(v: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            ratio = (v["r"] - x).cast("double") * (v["k"] - x) / ((x + 1).cast("double") * (v["n"] - v["r"] - v["k"] + x + 1))
            return F.struct((s["p"] + F.log(ratio)).alias("p"), (s["sum"] + F.when(keep(s["p"], v["seen"]), F.exp(s["p"])).otherwise(0.0)).alias("sum"))

        begin = F.struct(v["first"].alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sequence(v["low"], F.least(v["r"], v["k"])), begin, add, lambda s: F.least(F.lit(1.0), s["sum"]))

    return bind(bind(margins, bound), total)


def _by_support(a, b, c, d, short: Column, wide: Callable[[Column], Column], least: int) -> Column:
    """A support has as many tables as the smallest margin, and one more."""
    return F.when(F.least(a + b, c + d, a + c, b + d) < least, short).otherwise(bind(_margins(a, b, c, d), wide))


def fisher_p(a, b, c, d, whole_support: int = WHOLE_SUPPORT) -> Column:
    """Two-sided Fisher exact test: all tables at most as likely as the one seen (within 1e-7)."""
    return _by_support(a, b, c, d, _tail(a, b, c, d, lambda p, seen: p <= seen + 1e-7), _fisher_wide, whole_support)


def upper_tail_p(a, b, c, d, whole_support: int = WHOLE_SUPPORT) -> Column:
    """Chance of as many joint ones or more at fixed margins."""
    return _by_support(a, b, c, d, _tail(a, b, c, d, lambda p, seen: F.lit(True), start=d), _upper_wide, whole_support)


def hypergeometric(x: Column, r: Column, k: Column, n: Column) -> Column:
    """Chance of x joint ones of margins r and k of n, whatever their size."""
    m = F.struct(r.cast("long").alias("r"), k.cast("long").alias("k"), n.cast("long").alias("n"), (k.cast("double") / n).alias("p"), ((n - k).cast("double") / n).alias("q"))
    return F.exp(bind(m, lambda v: _ln_pmf_wide(x.cast("long"), v)))


def likely_support(r: Column, k: Column, n: Column) -> Column:
    """struct(low, high) of the joint ones whose chance counts in double precision."""
    long, real = lambda c: c.cast("long"), lambda c: c.cast("double")
    sd = F.sqrt(real(r) / n * k / n * (n - r) * real(n - k) / F.greatest(n - 1, F.lit(1)))
    wide, mode = F.ceil(_DEVIATIONS * sd) + _MORE_STEPS, F.floor(real(r + 1) * (k + 1) / (n + 2))
    return F.struct(long(F.greatest(F.lit(0), r + k - n, mode - wide)).alias("low"), long(F.least(r, k, mode + wide)).alias("high"))


def association(a, b, c, d) -> Column:
    """struct(chi2, p, phi, test) of the reference's rule: Fisher if an expected count is below 5, else Yates.

    All null for a table with an empty margin.  Fisher reports chi2 = phi^2 n.
    """
    n = a + b + c + d
    first = F.struct(phi(a, b, c, d).alias("phi"), (least_expected(a, b, c, d) < 5).alias("exact"))

    def more(v: Column) -> Column:
        ok = v["phi"].isNotNull()
        chi2 = F.when(ok, F.when(v["exact"], v["phi"] * v["phi"] * n).otherwise(yates_chi2(a, b, c, d)))
        p = F.when(ok, F.when(v["exact"], fisher_p(a, b, c, d)).otherwise(chi2_p(yates_chi2(a, b, c, d))))
        return F.struct(chi2.alias("chi2"), p.alias("p"), v["phi"].alias("phi"), F.when(ok, F.when(v["exact"], "fisher").otherwise("chi2")).alias("test"))

    return bind(first, more)


def stars(p: Column) -> Column:
    """``%.3f`` with stars below .05, .01 and .001; empty for null."""
    mark = F.when(p < 0.001, " ***").when(p < 0.01, " **").when(p < 0.05, " *").otherwise("")
    return F.when(p.isNull(), "").otherwise(F.concat(F.format_string("%.3f", p), mark))


def jaccard_distance(n11: Column, k1: Column, k2: Column) -> Column:
    """1 - overlap / union; 0 for two empty features."""
    union = k1 + k2 - n11
    return F.when(union == 0, 0.0).otherwise(1 - n11 / union)


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
