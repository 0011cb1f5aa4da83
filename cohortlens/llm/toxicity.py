"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses.  A lexical transducer maps each word to a symbol: insult,
harm, intent, target, negation, report, quotation, break or other.  Its insult arcs are
words and stems learned from labelled rows; the closed classes are short lists of verbs
and particles, verbs with their regular endings.  Five transducers read the symbols of a
clause: insult, threat (intent, then harm), target, negation (from its word to the next
break) and reported speech (to the end of the clause, or of the quotation).  They are
composed into one automaton whose output for a clause is the weight of its insults and
threats by reading: direct, aimed at a target, negated, reported.  A logistic model,
fitted on the same labelled rows, turns the clauses' sums into a score; how much a
negated or reported match counts is learned there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, prepare, tidy

#: Labelled rows used for training at most, taken by smallest hash of the id.
TRAIN_ROWS = 20_000
#: Insult arcs at most, by weight.
LEXICON = 4096
STEMS = (4, 5, 6, 7)
MEMO = 200_000
#: Arcs expected by chance among all stems tried; with more stems an arc needs more evidence.
BY_CHANCE = 3
#: Likely stems that the driver chooses arcs from at most: the most frequent ones (about 10 MB).
CANDIDATES = 1 << 16

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(9)

# Closed word classes in English, German, French and Spanish; verbs by their base forms.
HARM_VERBS = {"en": "kill hurt destroy beat stab shoot burn hang murder strangle punch".split(), "de": "töten schlagen umbringen verbrennen erschießen".split(),
              "fr": "tuer frapper brûler étrangler".split(), "es": "matar golpear quemar estrangular".split()}
REPORT_VERBS = {"en": "say call claim quote report state allege".split(), "de": "sagen behaupten zitieren nennen".split(), "fr": "appeler citer déclarer raconter".split(), "es": "llamar afirmar declarar contar".split()}
IRREGULAR = {HARM: "shot hung burnt umgebracht erschossen".split(),
             REPORT: "said wrote writes write written told tell tells according sagte schrieb schreibt nannte laut zufolge dit disent écrit selon dijo dice dicen escribió según".split()}
INTENT_WORDS = "will gonna going should must shall want i'll we'll werde werden sollte soll will vais veux dois va voy quiero debería va".split()
TARGET_WORDS = "you your yours he she him her they them their those people du dich dir sie ihr ihn tu toi vous il elle ils tú usted él ella ellos".split()
NEGATION_WORDS = "not no never neither nor without don't doesn't didn't isn't aren't wasn't weren't won't can't cannot nicht kein keine keinen nie niemals ohne ne pas jamais sans nunca jamás sin".split()
BREAK_WORDS = ", but aber sondern mais pero sino".split()
QUOTES = "\"“”„«»"
_ENDINGS = {"de": ("e", "st", "t", "en", "te", "ten", "end"), "fr": ("er", "e", "es", "ons", "ez", "ent", "é", "ait", "era", "erai", "ant"), "es": ("ar", "o", "as", "a", "amos", "an", "é", "ó", "aron", "ando", "ado", "aré", "ará")}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n,\"“”„«»]")
_ENDS = frozenset(".!?;:\n")


def inflected(verb: str, language: str) -> set[str]:
    """A verb's regular forms."""
    if language != "en":
        stem = verb[:-2]
        return {stem + x for x in _ENDINGS[language]} | ({f"ge{stem}t", f"ge{stem}en"} if language == "de" else set())
    stem = verb[:-1] if verb.endswith("e") else verb
    double = verb + verb[-1] if re.fullmatch(r".*[^aeiou][aeiou][bdgnpt]", verb) else stem
    return {verb, verb + "s", verb + "es", stem + "ed", stem + "ing", stem + "er", double + "ed", double + "ing"}


def closed_words() -> dict[str, int]:
    out = {q: QUOTE for q in QUOTES}
    for symbol, words in ((BREAK, BREAK_WORDS), (TARGET, TARGET_WORDS), (INTENT, INTENT_WORDS), (NEGATION, NEGATION_WORDS), *IRREGULAR.items()):
        out |= dict.fromkeys(words, symbol)
    for symbol, verbs in ((HARM, HARM_VERBS), (REPORT, REPORT_VERBS)):
        for language, names in verbs.items():
            for v in names:
                out |= dict.fromkeys(inflected(v, language), symbol)
    return out


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, output); missing arcs stay and say nothing."""

    arcs: dict[tuple[int, int], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, ""))


def grammar() -> dict[str, Transducer]:
    """The parts; no arc reads OTHER, so such words change nothing.  The report's state comes last."""
    hits = (INSULT, HARM)
    insult = Transducer({(0, INSULT): (0, "insult")})
    threat = Transducer({(0, INTENT): (1, ""), (1, HARM): (0, "threat"), (1, NEGATION): (0, ""), (1, BREAK): (0, "")})
    target = Transducer({(0, TARGET): (1, "aimed")})
    negation = Transducer({(0, NEGATION): (1, ""), (1, BREAK): (0, ""), **{(1, x): (1, "negated") for x in hits}})
    # 1: after a verb of speech, 2: in a quotation, 3: in one after such a verb
    report = Transducer({(0, REPORT): (1, ""), (0, QUOTE): (2, ""), (1, QUOTE): (3, ""), (2, QUOTE): (0, ""), (3, QUOTE): (0, ""), **{(s, x): (s, "reported") for s in (1, 2, 3) for x in hits}})
    return {"insult": insult, "threat": threat, "target": target, "negation": negation, "report": report}


class Composition:
    """The transducers run side by side; pairs of states are made when first met."""

    def __init__(self, parts: dict[str, Transducer]):
        self.parts = list(parts.values())
        self.table: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], frozenset[str]]] = {}
        self.start = (0,) * len(self.parts)

    def step(self, state: tuple[int, ...], symbol: int):
        key = (state, symbol)
        if key not in self.table:
            moved = [p.step(s, symbol) for p, s in zip(self.parts, state)]
            self.table[key] = (tuple(s for s, _ in moved), frozenset(x for _, x in moved if x))
        return self.table[key]


FEATURES = ("direct", "aimed", "negated", "reported", "threat", "strongest", "share")


def grams(text: str) -> set[str]:
    """Words (``=word``) and stems (their first letters) of a text."""
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        if len(w) > 2:
            out.add("=" + w)
            out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


class ToxicGrammar:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None = None):
        self.lexicon = lexicon
        self.weights = weights
        self.machine = Composition(grammar())
        self.closed = closed_words()
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: symbol and weight of a word."""
        found = self.memo.get(word)
        if found is None:
            weight = max([self.lexicon.get("=" + word, 0.0), *(self.lexicon.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
            found = (INSULT, weight) if weight else (self.closed.get(word, OTHER), 1.0)
            if len(self.memo) < MEMO:
                self.memo[word] = found
        return found

    def clauses(self, text: str) -> Iterator[tuple[int, dict[str, float]]]:
        """(number of words, weight of each reading) of every clause that has a match."""
        state, words, aimed = self.machine.start, 0, False
        heard: list[tuple[frozenset[str], float]] = []

        def close():
            out: dict[str, float] = {}
            for said, weight in heard:
                if "threat" in said:
                    kind = "negated" if "negated" in said else "reported" if "reported" in said else "threat"
                    weight = 1.0 if aimed else 0.5
                else:
                    kind = "negated" if "negated" in said else "reported" if "reported" in said else "aimed" if aimed else "direct"
                out[kind] = out.get(kind, 0.0) + weight
            return out

        for token in _TOKEN.findall(text.lower()):
            if token in _ENDS:
                if heard:
                    yield words, close()
                # an open quotation goes on in the next clause, to the end of the line
                state = (*self.machine.start[:-1], state[-1] if state[-1] > 1 and token != "\n" else 0)
                heard, words, aimed = [], 0, False
                continue
            symbol, weight = self.symbol(token)
            words += 1
            if symbol == OTHER:
                continue
            state, said = self.machine.step(state, symbol)
            if said:
                aimed = aimed or "aimed" in said
                if "insult" in said or "threat" in said:
                    heard.append((said, weight))
        if heard:
            yield words, close()

    def features(self, text: str) -> np.ndarray:
        total: Counter = Counter()
        best, inside = 0.0, 0
        for words, sums in self.clauses(text):
            total.update(sums)
            best, inside = max(best, sum(sums.values())), inside + words
        share = min(1.0, 50 * sum(total.values()) / (len(text) + 50))
        return np.array([math.log1p(total[k]) for k in FEATURES[:5]] + [math.log1p(best), share])

    def score(self, text: str) -> float:
        z = float(self.weights[0] + self.features(text) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def choose_lexicon(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, tried: int) -> dict[str, float]:
    """Insult arcs from numbers of toxic and clean texts: frequent in toxic ones and rare in clean ones.

    Of nested stems with nearly the same texts the longest stays, else the shortest.
    """
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)

    def surprise(t: int, c: int) -> float:
        """Chernoff's exponent: exp(-it) bounds the chance of t toxic texts of t + c."""
        q = t / (t + c)
        return (t + c) * (q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if c else 0.0)) if q > base else 0.0

    least = math.log(max(tried, 1000) / BY_CHANCE)
    good = {g: (t, c) for g, (t, c) in counts.items() if t >= 3 and c * 4 <= t and surprise(t, c) >= least}
    kept: dict[str, float] = {}
    stems = sorted((g for g in good if g[0] != "="), key=lambda g: (len(g), g))
    longer = {}
    for g in stems:
        longer[g[:-1]] = max(longer.get(g[:-1], 0), good[g][0])
    for g in stems:
        if longer.get(g, 0) * 100 >= 95 * good[g][0] or any(g[:n] in kept for n in range(STEMS[0], len(g))):
            continue
        kept[g] = 0.0
    for g in sorted(good):
        if g[0] == "=" and not any(g[1 : 1 + n] in kept for n in STEMS if len(g) > n):
            kept[g] = 0.0
    for g in kept:
        t, c = good[g]
        kept[g] = min(3.0, math.log((t + 0.5) * (n_clean + 1) / ((c + 0.5) * (n_toxic + 1))) / 3)
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; the first weight is the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Without labels of both kinds: any direct insult or threat is enough.
DEFAULT_WEIGHTS = np.array([-3.0, 3.0, 4.0, 0.5, 1.0, 4.0, 1.0, 1.0])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(grams(text or ""))
            (toxic if label else clean)[""] += 1
    names = sorted(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[g] for g in names], pa.int64()), pa.array([clean[g] for g in names], pa.int64())], ["gram", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicGrammar:
    """Learn from at most ``rows`` labelled rows whose crc32 of the id isn't divisible by 5.

    Rows without an id, text or label are left out; an id with several labels counts as
    toxic if one says so; ties of hashes go by the id; other columns, of any names, are
    ignored.  Empty tables, or labels of one kind, give a grammar without insults.  Near copies are taken once (by the smallest hash of three words in a row), so that
    the words of one much-copied text don't look like insults.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        "id is not null and toxic is not null and crc32(cast(cast(id as string) as binary)) % 5 <> 0")
    learn = learn.groupBy("id").agg(F.max("toxic").alias("toxic"))
    # About twice the rows by their hash, then exactly: no task sorts all labels.
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * rows / max(1, learn.count())))
    learn = learn.where(part).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(rows)
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    known = body.join(F.broadcast(learn), "id")
    words = F.split(F.lower("text"), r"\s+")
    known = known.withColumn("words", words)
    key = F.array_min(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    known = scratch.table(known.groupBy(key.alias("key")).agg(F.min_by(F.struct("text", "toxic"), F.struct("id", "text")).alias("r")).select("r.text", "r.toxic"), "sample")
    counted = known.mapInArrow(tidy(_sample_counts), "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = total[0], total[1] - total[0]
    if not n_toxic or not n_clean:
        return ToxicGrammar({}, DEFAULT_WEIGHTS)
    counted = scratch.table(counted.where((F.col("gram") != "") & (F.col("toxic") >= 3)), "counted")
    likely = counted.where(F.col("clean") * 4 <= F.col("toxic"))
    got = likely.orderBy(F.desc("toxic"), "gram").limit(CANDIDATES).collect()
    model = ToxicGrammar(choose_lexicon({r["gram"]: (r["toxic"], r["clean"]) for r in got}, n_toxic, n_clean, counted.count()))
    lexicon = model.lexicon

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicGrammar(lexicon)
        for batch in batches:
            x = [own.features(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("toxic")], ["x", "toxic"])

    got = known.mapInArrow(tidy(features), "x binary, toxic int").collect()
    x = np.stack([np.frombuffer(r["x"]) for r in got])
    y = np.array([r["toxic"] for r in got], float)
    order = np.lexsort((y, *x.T))  # the order of collected rows must not matter
    model.weights = fit_logistic(x[order], y[order])
    scratch.drop(known, counted)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicGrammar, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Null and empty texts get the score of a text without matches.  Columns named like
    the results are replaced; repeated rows stay; an empty table gives no rows.  A text of
    any length is read whole, clause by clause, in linear time.
    """
    prepare(docs.sparkSession)
    lexicon, weights = model.lexicon, model.weights
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicGrammar(lexicon, weights)
        for batch in batches:
            score = [own.score(t or "") for t in batch.column(len(names)).to_pylist()]
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), kinds)
