"""Words and word shingles of UTF-8 text as 64-bit hashes, computed on whole
Arrow buffers with numpy (no Python object per word).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; these bytes
never occur inside a multi-byte UTF-8 character, so bytes and characters agree.
Null texts have no words.  Texts of any length are handled in blocks cut at
white space, so that the tables stay a few MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
#: Bytes of the longest word that is hashed with all others; a longer one gets a digest of its own.
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit over the word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Odd multipliers whose differences have few factors of two, so that swapped words of a window differ.
_MULT = (mix(np.arange(1, 9, dtype=U64)) & ~U64(15)) | np.arange(1, 17, 2, dtype=U64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text (one row at least)."""
    _, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1)."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, at)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z lowered if asked).

    The bytes are chained eight at a time through ``mix``, and words of more than
    ``_LONG`` bytes are digested (BLAKE2b), so no family of words collides by its form
    as those of a polynomial modulo 2**64 do.  Words of up to eight bytes and of equal
    length can't collide at all.
    """
    size = e - s
    out = mix(size.astype(U64) * _MULT[1] + _MULT[0])
    if not len(s):
        return out
    text = np.zeros(len(raw) + 8, np.uint8)
    text[: len(raw)] = _LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw) + 1,), "<u8", text, strides=(1,))  # the eight bytes from each place on
    at, left, rows = s, size, None
    short = size <= _LONG
    if not short.all():
        for i in np.flatnonzero(~short).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(text[s[i] : e[i]], digest_size=8).digest(), "little")
        rows = np.flatnonzero(short)
        at, left = s[rows], size[rows]
    while len(at):
        x = eight[at]
        if (tail := left < 8).any():
            x[tail] &= (U64(1) << (left[tail] * 8).astype(U64)) - U64(1)
        if rows is None:
            out = mix((out ^ x) * _MULT[2])
            rows = np.arange(len(out))
        else:
            out[rows] = mix((out[rows] ^ x) * _MULT[2])
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def windows(words: np.ndarray, first: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and, for each text, the index of its first window (n + 1).

    With ``whole``, a text of 1 to k - 1 words gives one hash of all its words.
    """
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64) if whole else 0)
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(int(at[-1]), U64)
    if len(words) >= k:
        full = len(words) - k + 1
        h = np.zeros(full, U64)
        for i in range(k):
            h += words[i : i + full] * _MULT[i % 8] * U64(2 * (i // 8) + 1)
        h = mix(h)
        text = np.repeat(np.arange(len(count)), np.where(count >= k, many, 0))
        base = (first[:-1] - at[:-1])[text]
        spot = np.repeat(at[:-1], np.where(count >= k, many, 0)) + _ramp(np.where(count >= k, many, 0))
        out[spot] = h[spot + base]
    if whole:
        for n in range(1, k):
            rows = np.flatnonzero(count == n)
            if len(rows):
                h = np.full(len(rows), n * 0x2545F491 + 7, U64)
                for i in range(n):
                    h = mix(h * _MULT[7] + words[first[rows] + i] * _MULT[i % 8])
                out[at[rows]] = h
    return out, at


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, empty for texts without words."""
    for i, j in slices(column):
        raw, at = text_bytes(column.slice(i, j - i))
        s, e, first = word_spans(raw, at)
        h, pos = windows(word_hashes(raw, s, e), first, k)
        for r in range(j - i):
            yield i + r, np.unique(h[pos[r] : pos[r + 1]])


def crc32_rows(column: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each text's bytes (null: of none)."""
    import zlib

    raw, at = text_bytes(column)
    view = memoryview(raw)
    return np.array([zlib.crc32(view[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64)
