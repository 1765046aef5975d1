"""Toxicity by a weighted finite-state clause grammar.

Five small transducers (insult, threat, target, negation, reported speech) read a
clause as a string of word classes. ``compose`` turns them into one deterministic
machine; each insult or threat leaves it as an event that says whether it is aimed at
somebody, negated or only reported. A text's score is a logistic function of the
weights collected per kind of event, so whole clauses count, not isolated words.

Stems that mark insults are learned from labelled rows in addition to the fixed lists:
a stem (a word or a prefix of 4 to 7 letters) enters when it is far more frequent in
toxic texts. Null and empty texts have no clause and get the score of no event.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, shingle_sets

# Word classes of the grammar in English, German, French and Spanish.
INSULT = ("idiot moron stupid scum trash loser pathetic worthless disgusting clown "
          "dumm trottel abschaum imbécile crétin idiota imbécil basura").split()
THREAT = "kill hurt destroy beat murder töte schlage tuerai frapperai mataré pegaré".split()
TARGET = "you your they them he she her him these those du dich ihr euch tu vous toi ustedes usted vosotros".split()
NEGATION = "not no never nobody neither without isn't aren't nicht kein keine nie pas jamais nunca ni".split()
REPORT = ("said says say wrote claimed called quoted reported told sagte schrieb behauptete "
          "dit écrit dijo escribió \" “ ” « »").split()

#: Labelled rows the lexicon and the weights are fitted on, at most (rows in hash order).
FIT_ROWS = 20_000
#: Stems kept, at most; so the broadcast grammar has a fixed bound.
STEMS = 2_000
#: A stem is this many times likelier in toxic texts, and the evidence for any difference
#: (log likelihood ratio of its counts) is this high: far above the chance of all stems tried.
LIFT, EVIDENCE = 15.0, 18.0

I, T, Y, N, R, O = range(6)
SYMBOLS = (I, T, Y, N, R, O)
EVENTS = [f"{what}_{how}" for what in ("insult", "threat") for how in ("plain", "aimed", "negated", "reported")]
_CLAUSE_END = ".!?;\n"
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer on word classes; ``arcs[state][symbol] = (state, output)``."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]


def marker(symbol: int) -> Machine:
    """Writes 1 whenever the symbol is read: the insult and threat transducers."""
    return Machine((tuple((0, int(s == symbol)) for s in SYMBOLS),))


def near(symbol: int, reach: int) -> Machine:
    """Writes 1 at every place up to ``reach`` words after the symbol."""
    rows = []
    for left in range(reach + 1):  # words for which the symbol still reaches
        rows.append(tuple((reach if s == symbol else max(left - 1, 0), int(left > 0)) for s in SYMBOLS))
    return Machine(tuple(rows))


def latch(symbol: int) -> Machine:
    """Writes 1 at every place after the symbol within the clause."""
    return Machine(tuple(tuple((int(state or s == symbol), int(state)) for s in SYMBOLS) for state in (0, 1)))


def compose(machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """Product machine: next state and packed outputs, indexed by state * symbols + symbol."""
    sizes = [len(m.arcs) for m in machines]
    states = {s: i for i, s in enumerate(product(*map(range, sizes)))}
    step = np.zeros(len(states) * len(SYMBOLS), np.int32)
    output = np.zeros_like(step)
    for state, i in states.items():
        for s in SYMBOLS:
            arcs = [m.arcs[q][s] for m, q in zip(machines, state)]
            step[i * len(SYMBOLS) + s] = states[tuple(a[0] for a in arcs)]
            output[i * len(SYMBOLS) + s] = sum(a[1] << k for k, a in enumerate(arcs))
    return step, output


@dataclass
class Grammar:
    stems: dict[str, float]  # stem, with a closing blank where only the whole word counts, to weight
    weights: list[float] = field(default_factory=lambda: [2.0, 3.0, 0.7, 0.7, 2.0, 3.0, 0.7, 0.7])
    bias: float = -4.0

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state, _ready=None)

    def _compile(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(stem.rstrip(" "), (len(stem.rstrip(" ")), stem.endswith(" "), I, weight))
        for word in THREAT:
            if word not in found:
                found.add_word(word, (len(word), True, T, 2.0))
        found.make_automaton()
        step, output = compose([marker(I), marker(T), near(Y, 3), near(N, 3), latch(R)])
        back = compose([near(Y, 3)])  # a target may follow as well as precede
        classes = {w: c for words, c in ((TARGET, Y), (NEGATION, N), (REPORT, R)) for w in words}
        self._ready = found, step.tolist(), output.tolist(), back[0].tolist(), back[1].tolist(), classes

    def hits(self, low: str) -> dict[int, tuple[int, float]]:
        """Start of each word that begins with a stem, with its class and weight."""
        if self._ready is None:
            self._compile()
        out: dict[int, tuple[int, float]] = {}
        for end, (size, whole, kind, weight) in self._ready[0].iter(low):
            a = end - size + 1
            if a and low[a - 1].isalnum() or whole and low[end + 1:end + 2].isalnum():
                continue
            if weight > out.get(a, (0, 0.0))[1]:
                out[a] = (kind, weight)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Weight collected by each kind of event."""
        total = np.zeros(len(EVENTS))
        low = (text or "").lower()
        hits = self.hits(low) if low else {}
        at = 0
        for a in sorted(hits):
            if a < at:
                continue
            start = max(low.rfind(c, at, a) for c in _CLAUSE_END) + 1
            start = max(start, at)
            ends = [e for c in _CLAUSE_END if (e := low.find(c, a)) >= 0]
            at = min(ends, default=len(low))
            self._clause(low, start, at, hits, total)
        return total

    def _clause(self, low: str, start: int, end: int, hits: dict, total: np.ndarray) -> None:
        _, step, output, bstep, boutput, classes = self._ready
        words = [(m.start(), m[0]) for m in _TOKEN.finditer(low, start, end)]
        symbols = [hits[a][0] if a in hits else classes.get(w, O) for a, w in words]
        state, seen = 0, []
        for s in symbols:
            seen.append(output[state * 6 + s])
            state = step[state * 6 + s]
        state, aimed = 0, [0] * len(symbols)
        for k in range(len(symbols) - 1, -1, -1):
            aimed[k] = boutput[state * 6 + symbols[k]]
            state = bstep[state * 6 + symbols[k]]
        for (a, _), out, target in zip(words, seen, aimed):
            if out & 3:
                how = 3 if out & 16 else 2 if out & 8 else 1 if out & 4 or target else 0
                total[(0 if out & 1 else 4) + how] += hits[a][1]

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(np.log1p(self.features(text)), self.weights))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def default_grammar() -> Grammar:
    return Grammar({w + " ": 3.0 for w in INSULT})


def _sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows in hash order of the key; all of them when there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"], batch["label"]):
            words = set(_WORD.findall((text or "").lower()))
            stems = {w + " " for w in words if len(w) <= 16}
            for size in (4, 5, 6, 7):
                stems |= {w[:size] for w in words if len(w) > size}
            counts[int(label)].update(stems)
        stems = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"stem": stems, "clean": [counts[0][s] for s in stems],
                            "toxic": [counts[1][s] for s in stems]})


def choose_stems(learned: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of stems that begin alike, the shortest that tells as much; ``learned`` has support and lift.

    A stem goes if a longer one has most of its toxic texts and a far higher lift, or if
    a shorter one that stays has about its lift.
    """
    heads = lambda stem: [stem.rstrip(" ")[:k] for k in range(4, len(stem.rstrip(" ")) + stem.endswith(" "))]
    blurred = {head for stem, (n, lift) in learned.items() for head in heads(stem)
               if head in learned and n >= 0.8 * learned[head][0] and lift >= 3 * learned[head][1]}
    out: dict[str, float] = {}
    for stem in sorted(learned.keys() - blurred, key=lambda x: (len(x), x)):
        if not any(head in out and learned[head][1] * 3 >= learned[stem][1] for head in heads(stem)):
            out[stem] = math.log(learned[stem][1])
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [int(s[0].view(np.int64)) if len(s) else 0 for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["key", "text", "label", "least"])


def fit_grammar(labelled: DataFrame) -> Grammar:
    """Grammar fitted on rows (key, text, label 0/1), at most about FIT_ROWS of them.

    Of near copies, which share their least shingle hash, one speaks for all. Without a
    row of both labels the default grammar is returned.
    """
    scratch = Scratch(labelled.sparkSession)
    rows = _sample(labelled.filter("label in (0, 1)").select(F.col("key").cast("string").alias("key"), "text", "label"),
                   "key", FIT_ROWS)
    rows = rows.mapInArrow(_distinct, "key string, text string, label int, least long")
    rows = scratch.keep(rows.groupBy("least", "label").agg(F.min_by("text", "key").alias("text")).select("text", "label"))
    totals = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    grammar = default_grammar()
    if len(totals) < 2:
        return grammar
    rate = lambda c, n: (F.col(c) + F.lit(0.5)) / F.lit(n + 1.0)
    lift = rate("toxic", totals[1]) / rate("clean", totals[0])
    both, q = F.col("toxic") + F.col("clean"), totals[1] / (totals[0] + totals[1])
    part = lambda c, share: F.col(c) * F.log((F.col(c) + F.lit(1e-9)) / (both * F.lit(share)))
    stems = (rows.select("text", "label").mapInPandas(_stem_counts, "stem string, clean long, toxic long")
             .groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .filter((lift >= LIFT) & (part("toxic", q) + part("clean", 1 - q) >= EVIDENCE))
             .select("stem", "toxic", lift.alias("lift"))
             .orderBy(F.desc("toxic"), "stem").limit(STEMS).collect())
    chosen = choose_stems({r.stem: (int(r.toxic), float(r.lift)) for r in stems})
    grammar.stems |= {s: max(w, grammar.stems.get(s, 0.0)) for s, w in chosen.items()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [grammar.features(t).tolist() for t in batch["text"]]})

    seen = rows.select("text", "label").mapInPandas(measure, "label int, x array<double>").toPandas()
    x = np.log1p(np.stack(seen["x"].to_numpy()))
    grammar.weights, grammar.bias = _logistic(x, seen["label"].to_numpy(float))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps, weights kept at zero or above."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1). A map over rows; the grammar is bounded by STEMS."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = shared.value
        return pd.Series([g.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col(text)))
