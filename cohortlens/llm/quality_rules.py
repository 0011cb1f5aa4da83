"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text.  The ledger keeps the measurements
and one bit for each failed rule; policies are sets of bits under a version, so
applying another policy, or asking what a policy would keep without one of its
rules, reads only the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import prepare, tidy
from .shingles import slices, text_bytes, windows, word_hashes, word_spans

#: Rules in order of their bits.  The first two are the base rules.
RULES = ("few_words", "repeated_windows", "symbols", "exclamation", "capitals", "same_neighbours", "few_distinct", "repeated_lines", "word_length", "letters")
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versions of the policy: a document is rejected if it fails a rule of the mask.
POLICIES = {
    1: BIT["few_words"] | BIT["repeated_windows"],
    2: sum(BIT.values()),
}
CURRENT = 2

_FIXED = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("n_exclamations", "long"), ("n_letters", "long"), ("n_capitals", "long"), ("n_same_neighbours", "long"), ("n_distinct_words", "long"), ("n_lines", "long"),
]

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[ord("!")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # lead bytes: a character beyond ASCII counts as a letter
_LEAD = (np.arange(256) & 0xC0) != 0x80

WINDOW = 8


def measure(column: pa.Array) -> np.ndarray:
    """One row of measurements for each text (columns as in ``_FIXED``)."""
    out = np.zeros((len(column), len(_FIXED)), np.int64)
    for i, j in slices(column):
        out[i:j] = _measure(*text_bytes(column.slice(i, j - i)))
    return out


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[at[1:]] - run[at[:-1]]


def _repeats(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its value occur twice or more with its owner; does it occur earlier."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.empty_like(twice), np.empty_like(same)
    a[order], b[order] = twice, same
    return a, b


def _measure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    s, e, first = word_spans(raw, at)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    words = word_hashes(raw, s, e, lower=False)
    leads = np.concatenate([[0], np.cumsum(_LEAD[raw], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(leads[e] - leads[s])])
    # words in windows that occur twice
    h, pos = windows(words, first, WINDOW, whole=False)
    many = np.diff(pos)
    start = np.repeat(first[:-1] - pos[:-1], many) + np.arange(len(h))
    again, _ = _repeats(h, np.repeat(np.arange(len(n)), many))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start[again], 1)
    np.add.at(step, start[again] + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    # lines: between line feeds, a text's end closes its last one
    feed = np.flatnonzero(raw == 10)
    ends = np.concatenate([feed, at[1:]])
    owner_l = np.concatenate([np.searchsorted(at[1:], feed, "right"), np.arange(len(n))])
    rank = np.lexsort((ends, owner_l))
    ends, owner_l = ends[rank], owner_l[rank]
    head = np.r_[True, owner_l[1:] != owner_l[:-1]] if len(owner_l) else np.zeros(0, bool)
    begins = np.where(head, at[owner_l], np.r_[0, ends[:-1] + 1])
    has_word = np.searchsorted(s, ends) > np.searchsorted(s, begins)
    b, e2, o = begins[has_word], ends[has_word], owner_l[has_word]
    line = word_hashes(raw, b, e2, lower=False) if len(b) else np.zeros(0, np.uint64)
    _, earlier = _repeats(line, o)
    near = np.zeros(len(words), bool)
    if len(words):
        near[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    _, seen = _repeats(words, owner)
    count = len(n)
    return np.stack([
        n, chars[first[1:]] - chars[first[:-1]], _sums(_SYMBOL[raw], at), np.bincount(o[earlier], minlength=count), _sums(covered, first),
        _sums(_EXCLAIM[raw], at), _sums(_LETTER[raw], at), _sums(_CAPITAL[raw], at), _sums(near, first), n - _sums(seen, first), np.bincount(o, minlength=count),
    ], 1)


def failures(m: np.ndarray) -> np.ndarray:
    """Failure bits of each row of measurements; ratios are of whole numbers, so ties are exact."""
    n, chars, symbols, dup, repeat, shouts, letters, capitals, near, distinct, lines = m.T
    enough = n >= 20
    rules = {
        "few_words": ~enough,
        "repeated_windows": 100 * repeat > 30 * n,
        "symbols": 100 * symbols > 25 * n,
        "exclamation": 100 * shouts > 30 * n,
        "capitals": enough & (100 * capitals > 50 * letters),
        "same_neighbours": 100 * near > 20 * n,
        "few_distinct": enough & (1000 * distinct < 250 * np.minimum(n, 400)),
        "repeated_lines": (lines >= 4) & (100 * dup > 50 * lines),
        "word_length": enough & ((100 * chars < 180 * n) | (100 * chars > 2500 * n)),
        "letters": enough & (100 * letters < 40 * chars),
    }
    return sum(rules[name].astype(np.int64) * BIT[name] for name in RULES)


def rule_ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default), the measurements and ``failed``, the failure bits.

    Null texts count as empty: no words, so they fail ``few_words``.  Columns named like
    a measurement are replaced.  Repeated rows stay; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    fixed = [name for name, _ in _FIXED] + ["failed"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in fixed and (keep is not None or c != text_col)]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in fixed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(len(names)))
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(c) for c in m.T] + [pa.array(failures(m))]
            yield pa.RecordBatch.from_arrays(cols, [*names, *fixed])

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), ", ".join(kinds))


def apply_policy(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    base = F.col("failed").bitwiseAND(POLICIES[1]) != 0
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed").bitwiseAND(POLICIES[version]) == 0))


def ablations(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it fails, and rows kept without it.

    Reads the ledger only: one pass of bitwise tests and sums.
    """
    mask = POLICIES[version]
    hit = F.col("failed").bitwiseAND(mask)
    aggs = [F.count("*").alias("rows"), F.coalesce(F.sum((hit == 0).cast("long")), F.lit(0)).alias("kept")]
    for name in RULES:
        aggs += [F.coalesce(F.sum((hit.bitwiseAND(BIT[name]) != 0).cast("long")), F.lit(0)).alias(f"f_{name}"), F.coalesce(F.sum((hit == BIT[name]).cast("long")), F.lit(0)).alias(f"o_{name}")]
    one = ledger.agg(*aggs)
    rules = [r for r in RULES if BIT[r] & mask]
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), "rows", F.col(f"f_{r}").alias("failing"), F.col(f"o_{r}").alias("only_failing"),
                                                  (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in rules])))
