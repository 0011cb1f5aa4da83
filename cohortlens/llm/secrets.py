"""Secret scan: base patterns, and a character convolutional network over candidates.

A candidate is a run of the value alphabet of 16 characters or more with a letter and a
digit.  The network reads classes of the characters of a candidate and of its
surroundings (a long one by its ends and piece by piece).  It is trained on all labelled
findings: values that the base patterns find in the corpus, with what names them hidden,
are positives; candidates of a known harmless shape (addresses, paths, versions, dates,
names made of words) are negatives; other candidates have no label.  Findings of both
kinds made by a fixed rule, set in places of the corpus' texts, join them, so that kinds
of keys are learned that no base pattern knows.

All findings are dealt by hash into shards.  In a round each shard trains the network on
its own rows, in numpy in a task, and the shards' networks are averaged; one shard is
plain training.  The score is calibrated on every fifth finding of each label of all
shards, by counts, and of the thresholds that keep the wanted recall among them the most
precise is taken.  All candidates are scored; accepted
ones that no base finding holds are added as spans of kind ``network``, others confirm it.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, prepare, tidy

KINDS = ("assign", "access", "hex", "network")
#: Findings and places of a shard on average, made findings of each label that join them at least (as many as its findings of a label, if they are more), and rounds of training.
SHARD, MADE, ROUNDS = 1 << 15, 3_000, 7
#: Steps of a logit, and the largest: scores are counted, and given, on this grid.
GRID, LARGEST = 256, 64
#: Steps of a number in the shards' sums: whole numbers add up alike in any order.
FIXED = float(1 << 40)
RECALL = 0.98

_VALUE = r"[A-Za-z0-9+/_.=-]"


def _either(words: str) -> str:
    """A-Z or a-z for each letter, and no other character that case folding would allow."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The base patterns.
_ASSIGN = re.compile("(" + _either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(rf"(?<!{_VALUE}){_VALUE}{{16,}}+")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a maximal run of hex digits is the leftmost match of its start
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


def touching(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[bool, bool]]:
    """For each span: does one of the findings, ascending by start, hold it wholly; does one touch it.  A search for each span."""
    starts, far = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    out = []
    for s, e in spans:
        i, j = bisect_right(starts, s), bisect_left(starts, e)
        out.append((i > 0 and far[i - 1] >= e, j > 0 and far[j - 1] > s))
    return out


def findings(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start of the finding, start and end of its value) of the base patterns, whose spans are known."""
    out = [(m.start(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if any(k == 0 for _, k, _ in base) else []
    return out + [(a, a, b) for a, k, b in base if k]


_PIECE = re.compile(r"[0-9]{1,8}|(?:[a-z]+|[A-Z][a-z]*|[A-Z]+|[a-z]+(?:[A-Z][a-z]+)+)[0-9]{0,4}|[0-9]{1,4}[a-z]{1,3}")


_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def harmless(text: str, s: int, e: int) -> bool:
    """The candidate has a shape that secrets don't: (part of) an address, a UUID, or words and short numbers between separators."""
    if _UUID.fullmatch(text, s, e) or text[s - 1 : s] == "@" or text[e : e + 1] == "@":
        return True
    pieces = [x for x in re.split(r"[-+/_.=]", text[s:e]) if x]
    return all(_PIECE.fullmatch(x) and len(x) <= 24 for x in pieces)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- the network ----------------------------------------------------------------------------

LEFT, BODY, RIGHT = 20, 40, 8
LENGTH = LEFT + BODY + RIGHT
#: Character classes; then "other" and "beyond the text".
_CHARS = ("ae", "bcdf", "iou", "ghjklmnpqrstvwxyz", "AE", "BCDF", "IOU", "GHJKLMNPQRSTVWXYZ", "0123456789", "=", ":", "\"'", " ", "\n\t\r", "+/", "_-", ".@")
CLASSES = len(_CHARS) + 2
_CLASS = np.full(128, CLASSES - 2, np.uint8)
for _i, _chars in enumerate(_CHARS):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
FILTERS, WIDTH, HIDDEN = 24, 5, 16


def _codes(part: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"), 127).astype(np.int64)]


def window(before: str, body: str, after: str) -> np.ndarray:
    """Classes of the last LEFT characters before, BODY of the body (its start and its end) and the first RIGHT after."""
    out = np.full(LENGTH, CLASSES - 1, np.uint8)
    left, right = before[-LEFT:], after[:RIGHT]
    middle = body if len(body) <= BODY else body[: BODY // 2] + body[-(BODY // 2) :]
    out[LEFT - len(left) : LEFT] = _codes(left)
    out[LEFT : LEFT + len(middle)] = _codes(middle)
    out[LEFT + BODY : LEFT + BODY + len(right)] = _codes(right)
    return out


def windows(text: str, s: int, e: int) -> list[np.ndarray]:
    """Of a candidate: as a whole, and of one longer than BODY each piece of that length."""
    places = [(s, e)] + ([(min(k, e - BODY), min(k, e - BODY) + BODY) for k in range(s, e, BODY)] if e - s > BODY else [])
    return [window(text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]) for a, b in places]


# ---- made findings ------------------------------------------------------------------------------

_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _some(r: random.Random, chars: str, lo: int, hi: int) -> str:
    return "".join(r.choices(chars, k=r.randint(lo, hi)))


def made_secret(r: random.Random) -> str:
    """A random key: of one alphabet, with a prefix or padding, or of several parts."""
    base62, web = _LOW + _UP + _NUM, _LOW + _UP + _NUM + "-_"
    kind = r.randrange(9)
    if kind == 0:
        out = _some(r, _NUM + "abcdef", 20, 64)
    elif kind == 1:
        out = _some(r, _NUM + "ABCDEF", 20, 64)
    elif kind == 2:
        out = _some(r, base62, 16, 64)
    elif kind == 3:
        out = _some(r, base62 + "+/", 22, 88) + "=" * r.randrange(3)
    elif kind == 4:
        out = _some(r, web, 20, 88)
    elif kind == 5:
        out = _some(r, _LOW, 2, 4) + r.choice("_-") + (_some(r, _LOW, 3, 5) + r.choice("_-")) * r.randrange(2) + _some(r, base62, 16, 48)
    elif kind == 6:
        out = ".".join(_some(r, web, a, b) for a, b in ((16, 40), (30, 120), (30, 50)))
    elif kind == 7:
        out = _some(r, _UP + "234567", 16, 40)
    else:
        out = _some(r, _LOW, 3, 8) + "=" + _some(r, base62, 16, 40)
    return out if len(out) >= 16 and _LETTER.search(out) and _DIGIT.search(out) else made_secret(r)


def made_harmless(r: random.Random, words: list[str]) -> str:
    """A path, version, date, address, file, identifier of words and numbers, or UUID."""
    w = lambda: r.choice(words)
    n = lambda k: str(r.randrange(10**k))
    kind = r.randrange(9)
    if kind == 0:
        out = "/" + "/".join(w() + (n(1) if r.random() < 0.3 else "") for _ in range(r.randint(3, 12))) + r.choice(["", ".txt", ".py", ".html", "/" + n(4)])
    elif kind == 1:
        out = f"{w()}-{n(1)}.{n(2)}.{n(2)}{r.choice(['', '-beta.', '-rc', '_'])}{n(1)}{r.choice(['', '.tar.gz', '-x86_64', '-' + w()])}"
    elif kind == 2:
        out = f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}{r.choice('T_.')}{r.randint(0, 23):02d}{r.choice('.-')}{n(2)}{r.choice(['', '.' + n(3), 'Z'])}"
    elif kind == 3:
        out = f"{w()}.{w()}{n(1)}.{r.choice(['com', 'org', 'net', 'example.com'])}{r.choice(['', '/' + w() + '/' + n(4)])}"
    elif kind == 4:
        out = r.choice("_-").join([w() for _ in range(r.randint(2, 6))] + [n(r.randint(1, 4))])
    elif kind == 5:
        out = w() + "".join(w().capitalize() for _ in range(r.randint(1, 3))) + n(1)
    elif kind == 6:
        out = f"{w().upper()}_{r.randint(1990, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}_{n(4)}.{r.choice(['jpg', 'pdf', 'csv'])}"
    elif kind == 7:
        out = "-".join(_some(r, _NUM + "abcdef", k, k) for k in (8, 4, 4, 4, 12))
    else:
        out = f"{w()}={n(3)}/{w()}.{w()}={w()}{n(2)}"
    return out if len(out) >= 16 and _LETTER.search(out) and _DIGIT.search(out) else made_harmless(r, words)


def made_windows(places: list[tuple[str, str]], many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, labels) of made findings, half of each label, between the texts before and after of some places."""
    r = random.Random(seed)
    places = places or [("", "")]
    vowels, others = "aeiou", "bcdfghjklmnprstvw"
    words = sorted({w for p in places for x in p for w in re.findall(r"(?<![^ ])[a-z]{2,12}(?![^ ])", x)}) + ["".join(r.choice(others) + r.choice(vowels) for _ in range(r.randint(1, 4))) for _ in range(400)]
    x, y = [], []
    for _ in range(many):
        for label in (1, 0):
            before, after = r.choice(places)
            body = made_secret(r) if label else made_harmless(r, words)
            if label == 0 and len(body) > BODY and r.random() < 0.5:  # a piece of it
                at = r.randrange(len(body) - BODY)
                before, body, after = before + body[:at], body[at : at + BODY], body[at + BODY :] + after
            elif r.random() < 0.3:
                quote = r.choice("\"'")
                before, after = before + quote, quote + after
            x.append(window(before, body, after))
            y.append(label)
    return np.stack(x), np.array(y, float)


# ---- training -----------------------------------------------------------------------------------


@dataclass
class CharNetwork:
    """Convolution, ReLU, maximum over three regions, a hidden layer, a logistic output."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: share of the held-out positives that the threshold finds, and of what it finds that is positive
    recall: float = 0.0
    precision: float = 0.0
    #: findings of the corpus that were learned from or calibrated on: positives, negatives
    positives: int = 0
    negatives: int = 0

    NAMES = ("w1", "b1", "w2", "b2", "w3", "b3")

    #: regions of the convolution's output: before, in and after the candidate
    REGIONS = ((0, LEFT - 2), (LEFT - 2, LEFT + BODY - 4), (LEFT + BODY - 4, LENGTH - WIDTH + 1))

    @classmethod
    def new(cls, seed: int) -> CharNetwork:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.2, (WIDTH * CLASSES, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.2, HIDDEN), 0.0)

    @staticmethod
    def _patches(x: np.ndarray) -> np.ndarray:
        hot = np.eye(CLASSES, dtype=np.float32)[x]
        return np.concatenate([hot[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], 2)

    def _forward(self, x: np.ndarray):
        p = self._patches(x)
        z = p @ self.w1 + self.b1
        tops = [z[:, a:b].argmax(1) + a for a, b in self.REGIONS]
        pooled = np.concatenate([np.take_along_axis(z, t[:, None, :], 1)[:, 0] for t in tops], 1)
        active = np.maximum(pooled, 0)
        h = active @ self.w2 + self.b2
        return p, tops, pooled, active, h, np.maximum(h, 0) @ self.w3 + self.b3

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scored(self.places(x) / GRID)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Logits in steps of the grid."""
        return np.rint(np.clip(self.logits(x), -LARGEST, LARGEST) * GRID).astype(np.int64)

    def _scored(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, steps: int, seed: int, rate: float = 3e-3) -> tuple[np.ndarray, int]:
        """One epoch of Adam on the log loss from ``state`` (see ``state``) after so many steps: the state and steps after it."""
        half = len(state) // 3
        self._set(state[:half])
        mean, root = self._parts(state[half : 2 * half]), self._parts(state[2 * half :])
        square = {n: root[n] ** 2 for n in self.NAMES}
        order = np.random.default_rng(seed).permutation(len(x))
        for i in range(0, len(x), 64):
            rows = order[i : i + 64]
            p, tops, pooled, active, h, out = self._forward(x[rows])
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)
            g = {"w3": np.maximum(h, 0).T @ d, "b3": d.sum()}
            dh = d[:, None] * self.w3 * (h > 0)
            g["w2"], g["b2"] = active.T @ dh, dh.sum(0)
            da = dh @ self.w2.T * (pooled > 0)
            g["b1"] = sum(da[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(3))
            at = np.arange(len(rows))[:, None]
            g["w1"] = sum(np.einsum("bf,bfd->df", da[:, k * FILTERS : (k + 1) * FILTERS], p[at, top]) for k, top in enumerate(tops))
            steps += 1
            for n in self.NAMES:
                mean[n] = 0.9 * mean[n] + 0.1 * g[n]
                square[n] = 0.999 * square[n] + 0.001 * g[n] ** 2
                change = rate * (mean[n] / (1 - 0.9**steps)) / (np.sqrt(square[n] / (1 - 0.999**steps)) + 1e-8)
                setattr(self, n, getattr(self, n) - change)
        own = {n: getattr(self, n) for n in self.NAMES}
        return np.concatenate([np.ravel(part[n]) for part in (own, mean, {n: np.sqrt(square[n]) for n in self.NAMES}) for n in self.NAMES]), steps

    def state(self) -> np.ndarray:
        """The numbers of the network, then as many means of gradients and roots of mean squares, which are 0 at the start."""
        own = np.concatenate([np.ravel(getattr(self, n)) for n in self.NAMES])
        return np.concatenate([own, np.zeros(2 * len(own))])

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([np.size(getattr(self, n)) for n in self.NAMES])[:-1]
        return {n: part.reshape(np.shape(getattr(self, n))) for n, part in zip(self.NAMES, np.split(flat, ends))}

    def _set(self, flat: np.ndarray) -> None:
        for n, part in self._parts(flat).items():
            setattr(self, n, part.copy() if part.ndim else float(part))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        z, at = np.unique(self.places(x), return_inverse=True)
        self.calibrate_counts(z, np.bincount(at, y == 1, len(z)), np.bincount(at, y == 0, len(z)), recall)

    def calibrate_counts(self, places: np.ndarray, yes: np.ndarray, no: np.ndarray, recall: float) -> None:
        """Platt scaling, then of the thresholds that find ``recall`` of the positives the most precise, and of those the lowest.

        ``yes`` and ``no`` count the positives and negatives at each of the places.
        """
        z = places / GRID
        sure, unsure = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)  # no certainty from what was seen
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = (yes + no) * (p * (1 - p) + 1e-9)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            off = yes * (sure - p) + no * (unsure - p)
            da, db = np.linalg.solve(h, [(off * z).sum(), off.sum()])
            a, b = max(0.05, a + np.clip(da, -1, 1)), b + np.clip(db, -1, 1)
        self.scale, self.shift = float(a), float(b)
        score, at = np.unique(self._scored(z), return_inverse=True)
        yes, no = np.bincount(at, yes, len(score)), np.bincount(at, no, len(score))
        hits, alarms = np.cumsum(yes[::-1])[::-1], np.cumsum(no[::-1])[::-1]  # at a score or above
        allowed = np.flatnonzero((yes > 0) & (yes.sum() - hits <= int((1 - recall) * yes.sum())))
        best = allowed[int(np.argmax(hits[allowed] / (hits[allowed] + alarms[allowed])))]
        self.threshold = float(score[best])
        self.recall, self.precision = float(hits[best] / yes.sum()), float(hits[best] / (hits[best] + alarms[best]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, x): windows of positives (1) and negatives (0), and one place of each text (2) as what is before and after."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for at, s, e in findings(text, base):
                if e - s >= 16 and _LETTER.search(text, s, e) and _DIGIT.search(text, s, e):
                    # what names the value is left out, so that the value itself is learned
                    rows.append((1, window(text[max(0, at - LEFT) : at], text[s:e], text[e : e + RIGHT]).tobytes()))
            spans = candidates(text)
            for (s, e), (_, near) in zip(spans, touching(spans, base)):
                if not near and harmless(text, s, e):
                    rows += [(0, w.tobytes()) for w in windows(text, s, e)]
            at = text.find(" ", zlib.crc32(text.encode()) % max(1, len(text)))
            if at >= 0:
                rows.append((2, "\0".join((text[max(0, at - LEFT) : at + 1], text[at : at + RIGHT])).encode()))
        cols = list(zip(*rows)) if rows else [[]] * 2
        hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=7).digest(), "big") for x in cols[1]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(hashes, pa.int64())], ["kind", "x", "h"])


def _shard(group: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(windows, labels, which are held out, positives, negatives of the corpus) of a shard, whatever the order of its rows."""
    rows = {kind: [] for kind in range(4)}
    for _, kind, x in sorted(zip(*(group.column(c).to_pylist() for c in ("h", "kind", "x")))):
        rows[kind].append(x)
    x, y = made_windows([tuple(p.decode().split("\0", 1)) for p in rows[2] if p.count(b"\0") == 1], max(MADE, len(rows[0]), len(rows[1])), seed)
    own = [np.frombuffer(w, np.uint8).reshape(-1, LENGTH) for label in (1, 0) if (w := b"".join(rows[label]))]
    x = np.concatenate([x, *own])
    y = np.concatenate([y, np.ones(len(rows[1])), np.zeros(len(rows[0]))])
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::5]] = True
    return x, y, held, len(rows[1]), len(rows[0])


def train(docs: DataFrame, text_col: str = "text", recall: float = RECALL, seed: int = 11) -> CharNetwork:
    """The network, from all texts.  Null texts are left out; a corpus without findings, or an empty table, leaves the made ones.

    Findings that look alike in their windows count once, and are dealt by the hash of the
    window into shards of about ``SHARD``, so the result doesn't depend on partitions,
    repeated rows or the order of rows.  The driver sees sums of networks, one from each
    task, and the counts of held-out scores on their grid.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "secrets")
    body = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = scratch.table(body.mapInArrow(tidy(_rows), "kind int, x binary, h long").distinct(), "findings")
    many = max(1, -(-found.count() // SHARD))
    # a row of no kind, so that a shard without findings has its made ones
    each = spark.range(many).select(F.lit(3).alias("kind"), F.lit(b"").alias("x"), F.lit(0).cast("long").alias("h"), F.col("id").cast("int").alias("shard"))
    dealt = found.withColumn("shard", F.pmod("h", F.lit(many)).cast("int")).union(each)

    def build(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        x, y, held, yes, no = _shard(group, seed + shard)
        return pa.table({"shard": pa.array([shard], pa.int32()), "x": [x.tobytes()], "y": [y.astype(np.uint8).tobytes()], "held": [held.tobytes()], "yes": [yes], "no": [no]})

    shards = scratch.table(dealt.groupBy("shard").applyInArrow(build, "shard int, x binary, y binary, held binary, yes long, no long"), "shards")
    scratch.drop(found)

    def read(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for x, y, h in zip(*(batch.column(c) for c in ("x", "y", "held"))):
                part = np.frombuffer(h.as_py(), bool) == held
                yield np.frombuffer(x.as_py(), np.uint8).reshape(-1, LENGTH)[part], np.frombuffer(y.as_py(), np.uint8)[part].astype(float)

    def trained(state: np.ndarray, steps: int, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, taken, n = np.zeros(len(state), np.int64), 0, 0
            for x, y in read(batches, False):
                after, more = CharNetwork.new(seed).fit(x, y, state, steps, turn)
                total, taken, n = total + np.rint(after * FIXED).astype(np.int64), taken + more, n + 1
            if n:
                yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "steps": pa.array([taken], pa.int64()), "n": pa.array([n], pa.int64())})

        return run

    net = CharNetwork.new(seed)
    state, steps = net.state(), 0
    for turn in range(ROUNDS):
        parts = shards.mapInArrow(tidy(trained(state, steps, turn)), "total binary, steps long, n long").collect()
        state = sum(np.frombuffer(p["total"], np.int64) for p in parts) / FIXED / many
        steps = sum(p["steps"] for p in parts) // many
    net._set(state[: len(state) // 3])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in read(batches, True):
            place, at = np.unique(net.places(x), return_inverse=True)
            yield pa.RecordBatch.from_pydict({"place": place, "yes": np.bincount(at, y == 1, len(place)).astype(np.int64), "no": np.bincount(at, y == 0, len(place)).astype(np.int64)})

    counts = shards.mapInArrow(tidy(score), "place long, yes long, no long").groupBy("place").agg(F.sum("yes"), F.sum("no")).orderBy("place").collect()
    net.calibrate_counts(*(np.array(c) for c in zip(*counts)), recall)
    net.positives, net.negatives = shards.agg(F.sum("yes"), F.sum("no")).first()
    scratch.drop(shards)
    return net


# ---- scans --------------------------------------------------------------------------------------


def find_spans(texts: list[str], net: CharNetwork | None) -> list[tuple[list[tuple[int, int, int]], int]]:
    """For each text: base spans with those that the network adds, and how many base findings an accepted candidate confirms."""
    spans = [base_spans(t) for t in texts]
    if net is None:
        return [(s, 0) for s in spans]
    where, x, owner = [], [], []
    for i, t in enumerate(texts):
        for s, e in candidates(t):
            own = windows(t, s, e)
            x += own
            owner += [len(where)] * len(own)
            where.append((i, s, e))
    accepted: list[list[tuple[int, int]]] = [[] for _ in texts]
    if x:
        score = np.zeros(len(where))
        np.maximum.at(score, owner, net.scores(np.stack(x)))
        for (i, s, e), p in zip(where, score):
            if p >= net.threshold:
                accepted[i].append((s, e))
    out = []
    for base, taken in zip(spans, accepted):
        new = [(s, 3, e) for (s, e), (held, _) in zip(taken, touching(taken, base)) if not held]
        confirmed = sum(near for _, near in touching([(a, b) for a, _, b in base], [(s, 0, e) for s, e in taken])) if taken else 0
        out.append((sorted(base + new), confirmed))
    return out


def scan_secrets(docs: DataFrame, net: CharNetwork | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with n_assign, n_access, n_hex, n_network, n_confirmed, base_sha256 and spans.

    n_network counts spans that the network adds, n_confirmed base findings that it
    would have found.  Without a network there are neither.  Null texts count as empty: no spans.  Offsets are code points, ends exclusive; spans
    are ordered by start, then kind.  Texts and candidates of any length are read whole, in
    time linear in their length.  Columns named like the results are replaced;
    repeated rows stay; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    fixed = ["n_assign", "n_access", "n_hex", "n_network", "n_confirmed", "base_sha256", "spans"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in fixed]
    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in fixed[:5]] + [f"{c} string" for c in fixed[5:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = find_spans([t or "" for t in batch.column(len(names)).to_pylist()], net)
            found = [s for s, _ in both]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)] + [pa.array([n for _, n in both], pa.int64())]
            base = [hashlib.sha256(span_text([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            cols = [batch.column(i) for i in range(len(names))] + counts + [pa.array(base, pa.string()), pa.array([span_text(s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*names, *fixed])

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), kinds)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """Each span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, net: CharNetwork | None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all found spans masked in the text; null texts stay null."""
    prepare(docs.sparkSession)
    names, text_at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = find_spans([t or "" for t in texts], net)
            clean = pa.array([redact(t, s) if s else t for t, (s, _) in zip(texts, found)], batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([clean if i == text_at else batch.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(tidy(run), docs.schema)
