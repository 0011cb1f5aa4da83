"""Random numbers as functions of what they are for, alike in Spark, numpy and SQL.

``unit_md5`` is for few draws by name.  ``unit`` is for many: a few steps of integer
arithmetic modulo the prime 2**31 - 1, two of them squares, on (row, replicate, seed).
No state is kept, so draws don't depend on partitions or order.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, functions as F, types as T

PRIME = 2147483647
#: Steps of a Poisson(1) draw: the distribution function at 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def unit_md5(*parts: object) -> float:
    """In (0, 1), from the texts of the parts."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)


def unit_md5_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT + 0.5) / {float(1 << 52)}"


def unit_md5_column(*parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def limit_md5(p: float) -> str:
    """What 13 digits of a digest are below of, as text, where their draw is below p."""
    at = math.ceil(Fraction(p) * (1 << 52) - Fraction(1, 2))
    return "g" if at >= 1 << 52 else f"{max(0, at):013x}"


def digits_md5_column(*parts: Column) -> Column:
    """The digits of ``unit_md5_column``'s draw: as texts they are in the order of the numbers, so a draw is compared (see ``limit_md5``) without being read."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.md5(text.cast("binary")), 1, 13)


def row_key(row: Column, kind: T.DataType) -> Column:
    """A number from 0 on: the row's own where it is one."""
    return F.abs(row.cast("long")) if isinstance(kind, T.IntegralType) else F.xxhash64(row).bitwiseAND((1 << 63) - 1)


def name_key(name: str) -> int:
    """A number below 2**52 from a name: one digest for all its draws."""
    return int(hashlib.md5(str(name).encode()).hexdigest()[:13], 16)


def name_key_sql(name: str) -> str:
    return f"('0x' || substr(md5({name}), 1, 13))::BIGINT"


def unit(key, replicate, seed: int):
    """In (0, 1) for arrays or columns of whole numbers from 0 on."""
    low, high = key % PRIME, key - key % PRIME
    high = F.round(high / PRIME).cast("long") if isinstance(key, Column) else high // PRIME
    a = (low * 48271 + replicate * 69621 + seed * 16807 + 1) % PRIME
    b = (a * a + high * 40014 + replicate) % PRIME
    c = (b * 48271 + 11) % PRIME
    d = (c * c + a) % PRIME
    return (d + 0.5) / float(PRIME)


def unit_sql(source: str, key: str, replicate: str, seed: str) -> str:
    """The rows of a DuckDB relation with ``u``."""
    p = PRIME
    a = f"SELECT *, ((({key}) % {p}) * 48271 + ({replicate}) * 69621 + ({seed}) * 16807 + 1) % {p} AS a_ FROM {source}"
    b = f"SELECT *, (a_ * a_ + (({key}) // {p}) * 40014 + ({replicate})) % {p} AS b_ FROM ({a})"
    c = f"SELECT *, (b_ * 48271 + 11) % {p} AS c_ FROM ({b})"
    return f"SELECT * EXCLUDE (a_, b_, c_), ((c_ * c_ + a_) % {p} + 0.5) / {float(p)} AS u FROM ({c})"


#: The smallest of the last steps' whole numbers whose draw is above each of the distribution function's values.
_ABOVE = [next(d for d in range(int(x * PRIME) - 2, PRIME + 1) if (d + 0.5) / float(PRIME) > x or d == PRIME) for x in POISSON]


def _folded(x: np.ndarray) -> np.ndarray:
    """Equal modulo the prime, and at most 2**31 more than the rest of the division, without dividing; in place."""
    high = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += high
    return x


def poisson(key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) draws of ``unit`` for each key (whole numbers from 0 on) and each replicate below ``replicates``, as small numbers.

    The same draws as ``searchsorted(POISSON, unit(...))``; the prime is 2**31 - 1, so a
    division is a shift and a sum.  A call should be of some 10**5 draws, which stay in the cache.
    """
    key, replicate, prime = np.asarray(key, np.int64), np.arange(replicates, dtype=np.int64), np.uint32(PRIME)
    low, high = key % PRIME, key // PRIME
    a = np.add.outer(((low * 48271 + seed * 16807 + 1) % PRIME).astype(np.uint32), (replicate * 69621 % PRIME).astype(np.uint32))
    np.minimum(a, a - prime, out=a)  # below the prime the difference wraps round and is larger
    x = a.astype(np.uint64)
    x *= x
    x += np.add.outer((high * 40014 % PRIME).astype(np.uint64), replicate.astype(np.uint64))
    x = _folded(x)
    x *= np.uint64(48271)
    x += np.uint64(11)
    x = _folded(_folded(x))
    x *= x
    x += a
    d = _folded(x).astype(np.uint32)
    for _ in range(2):
        np.minimum(d, d - prime, out=d)
    out = np.zeros(d.shape, np.uint8)
    for at in _ABOVE:
        if at < PRIME:
            out += (d >= np.uint32(at)).view(np.uint8)
    return out


def poisson_column(u: Column) -> Column:
    return sum((F.when(u > float(x), 1).otherwise(0) for x in POISSON), F.lit(0))


def poisson_sql(u: str) -> str:
    return " + ".join(f"({u} > {float(x)!r})::INT" for x in POISSON)
