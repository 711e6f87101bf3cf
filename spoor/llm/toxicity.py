"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. Five transducers read a clause's words. The insult
and the threat transducer emit weights and are joined by union; the target,
negation and reported-speech transducers mark what stands near their words and
scale what is emitted there. All are composed into one automaton over product
states. A clause's score is the sum of what it emits, so the same insult counts
more when aimed at someone and less when negated or quoted; a threat counts
only in a clause that has a target.

The insult transducer's words and word beginnings, with log-odds weights, are
learned from labelled rows. So is the logistic model that turns a document's
clause scores into a probability; it sees apart what was emitted where the
target, negation and report transducers were active and what the threat
transducer emitted, so how much each of the five counts is learned too, from
labelled texts, starting at the factors below. Both use at most ``max_rows``
rows of each class, those whose digest is lowest: a documented bound on what
reaches the driver. Every document is scored from its whole text, by its words
alone.

Defined results: null and empty texts have no clauses and get the model's base
score; labels that are null are left out; a document with several labels counts
as toxic if one is; without labels of both classes the weights are those of the
fixed lists alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, released, text_of, unpacked, written

# Word lists in English, German, French and Spanish.
TARGETS = frozenset("""you your yours yourself yourselves u ya they them their him his he her hers she these those people everyone everybody nobody folks guys
du dich dir dein deine deinen deinem euch euer eure ihr ihnen sie ihn tu toi te vous votre vos ton ta tes ils elles eux leur leurs
tú ti tu tus usted ustedes vosotros vosotras os vuestro vuestra eres sois ellos ellas les""".split())
NEGATIONS = frozenset("""not no never neither nor none without cannot isn aren wasn weren don doesn didn won wouldn shouldn nicht kein keine keinen keiner niemals nie ohne weder
ne pas jamais aucun aucune sans ni nunca jamás sin tampoco ningún ninguna""".split())
REPORTS = frozenset("""said says say saying told tells wrote writes writing called calls claimed claims quoted quotes quoting reported reports stated according allegedly
sagte sagt sagen schrieb schreibt nannte nennt laut angeblich behauptet dit disent écrit écrivait selon appelle appelé affirme prétend
dijo dice dicen escribió escribe según llamó llama afirma""".split())
THREATS = frozenset("""kill murder hurt destroy beat stab shoot burn strangle slaughter hang crush töten umbringen ermorden schlagen erschießen erstechen verbrennen
tuer assassiner frapper détruire brûler poignarder matar golpear destruir quemar apuñalar asesinar""".split())

_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?;:,\n|]+")
#: Lengths of the word beginnings that the insult transducer may learn.
STEMS = range(4, 9)


# ---- transducers ---------------------------------------------------------
# Symbols: I insult, H threat, T target, N negation, R reported speech, O any other word.


class Emitter(NamedTuple):
    """A transducer of one state that emits ``factor`` times the word's weight at its symbol."""

    name: str
    symbol: str
    factor: float


class Context(NamedTuple):
    """A transducer that is active in the ``words`` words after its symbol and scales there what is emitted."""

    name: str
    symbol: str
    words: int
    factor: float

    def step(self, left: int, symbol: str) -> int:
        """How many words more it is active; it is active at a word if that is positive before the word is read."""
        return self.words if symbol == self.symbol else max(0, left - 1)


INSULT, THREAT = Emitter("insult", "I", 1.0), Emitter("threat", "H", 2.0)
TARGET, NEGATION, REPORT = Context("target", "T", 6, 1.3), Context("negation", "N", 3, 0.5), Context("report", "R", 1 << 30, 0.7)


class Grammar:
    """The union of the emitters, composed with the contexts: states are products, factors multiply."""

    def __init__(self, *machines: Emitter | Context):
        self.emitters = {m.symbol: m for m in machines if isinstance(m, Emitter)}
        self.contexts = [m for m in machines if isinstance(m, Context)]
        self.start = (0,) * len(self.contexts)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, float, tuple]:
        """The next state, the factor of what is emitted at the symbol (0: nothing), and which contexts are active there."""
        active = tuple(left > 0 for left in state)
        found = self.emitters.get(symbol)
        factor = math.prod((m.factor for m, on in zip(self.contexts, active) if on), start=found.factor) if found else 0.0
        return tuple(m.step(left, symbol) for m, left in zip(self.contexts, state)), factor, active


MACHINES = (INSULT, THREAT, TARGET, NEGATION, REPORT)
GRAMMAR = Grammar(*MACHINES)
#: What a document's features tell apart: the contexts in order, then threats.
PARTS = ("target", "negation", "report", "threat")
N_FEATURES = 4 + len(PARTS)


@dataclass
class Lexicon:
    """Insult weights of words and of word beginnings (written with a star)."""

    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[word] = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        return found

    def __getstate__(self):
        return {"weights": self.weights, "memo": {}}


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if k <= len(word))]


def clause_scores(text: str, lexicon: Lexicon, grammar: Grammar = GRAMMAR) -> tuple[list[tuple[float, dict[str, float]]], int]:
    """(score, parts of it by context and for threats) of each clause that the grammar matches, and the number of clauses."""
    lowered = text.lower()
    weight = lexicon.weight
    marked = {w for w in set(_WORD.findall(lowered)) if weight(w) > 0 or w in THREATS}
    clauses = _CLAUSE.split(lowered)
    if not marked:
        return [], len(clauses)
    scores = []
    for clause in clauses:
        words = _WORD.findall(clause)
        if marked.isdisjoint(words):
            continue
        aimed = not TARGETS.isdisjoint(words)
        state, score, parts = grammar.start, 0.0, {}
        for word in words:
            own = weight(word) if word in marked else 0.0
            symbol = "I" if own else "H" if word in THREATS and aimed else "T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "O"
            state, factor, active = grammar.step(state, symbol)
            if not factor:
                continue
            score += factor * (own or 1.0)
            for name in [m.name for m, on in zip(grammar.contexts, active) if on] + (["threat"] if symbol == "H" else []):
                parts[name] = parts.get(name, 0.0) + (own or 1.0)
        if score > 0:
            scores.append((score, parts))
    return scores, len(clauses)


def document_features(text: str, lexicon: Lexicon, grammar: Grammar = GRAMMAR) -> tuple[float, ...]:
    """Greatest clause score, logarithms of their sum and number, sum by clauses; logarithms of the sums of ``PARTS``."""
    scores, clauses = clause_scores(text, lexicon, grammar)
    total = sum(s for s, _ in scores)
    parts = (math.log1p(sum(p.get(name, 0.0) for _, p in scores)) for name in PARTS)
    return max((s for s, _ in scores), default=0.0), math.log1p(total), math.log1p(len(scores)), total / math.log(2 + clauses), *parts


# ---- learning ------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most ``max_rows`` labelled rows of each class that are not held out, and the classes' true sizes."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("lid")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "toxic-labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("lid"), "lid").limit(max_rows) for y in (0, 1)]
    # At most 2 * max_rows rows of two numbers: a proven bound for the broadcast.
    sample = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("lid"))
    return written(sample.select("doc_id", "toxic", "text"), "toxic-sample"), sizes


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = (Counter(), Counter())
        for toxic, text in zip(batch["toxic"], batch["text"]):
            counts[int(toxic)].update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"feature": names, "n1": [counts[1][f] for f in names], "n0": [counts[0][f] for f in names]})


def learn_lexicon(sample: DataFrame, n1: int, n0: int, least_docs: int = 4, least_weight: float = 1.5, least_g2: float = 18.0) -> Lexicon:
    """Words and beginnings whose presence speaks for the toxic class: log-odds at least ``least_weight``, likelihood ratio at least ``least_g2``. All of them; the sample bounds their number."""
    if not n1 or not n0:
        return Lexicon()
    counts = sample.select("toxic", "text").mapInPandas(_count_features, "feature string, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1"), F.col("n0")
    expected1, expected0 = (a + b) * (n1 / (n1 + n0)), (a + b) * (n0 / (n1 + n0))
    g2 = 2 * (a * F.ln(a / expected1) + F.when(b > 0, b * F.ln(b / expected0)).otherwise(0.0))
    weight = F.ln((a + 0.5) / (n1 + 1)) - F.ln((b + 0.5) / (n0 + 1))
    rows = counts.filter(a >= least_docs).select("feature", weight.alias("weight"), g2.alias("g2")).filter(f"weight >= {least_weight} and g2 >= {least_g2}").collect()
    return Lexicon({r["feature"]: r["weight"] for r in rows})


def _feature_map(lexicon: Lexicon, grammar: Grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [list(document_features(t, lexicon, grammar)) for t in batch["text"]]})

    return released(run)


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    grammar: Grammar = GRAMMAR

    def of_features(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[0] + ((x - self.mean) / self.scale) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, texts) -> np.ndarray:
        return self.of_features(self.features(texts))

    def features(self, texts) -> np.ndarray:
        return np.array([document_features(t, self.lexicon, self.grammar) for t in texts]).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, ridge: float = 1.0, grammar: Grammar = GRAMMAR) -> Model:
    """Learn the insult transducer and the logistic model from labelled rows that are not held out."""
    sample, sizes = labelled_sample(docs, labels, max_rows)
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(sample, seen.get(1, 0), seen.get(0, 0))
    rows = sample.mapInPandas(_feature_map(lexicon, grammar), "toxic int, x array<double>").toPandas()
    x, y = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([-4.0, 1.0, 1.0, *[0.0] * (N_FEATURES - 2)]), grammar)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)  # what no labelled text has keeps the weight 0
    # A row weighs as many as its class has, so that the two bounds do not shift the base rate.
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
    design = np.hstack([np.ones((len(y), 1)), (x - mean) / scale])
    coef, penalty = np.zeros(1 + N_FEATURES), ridge * np.array([1e-6, *[1.0] * N_FEATURES])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ coef, -40, 40)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty), design.T @ (weight * (y - p)) - penalty * coef)
        coef = coef + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return Model(lexicon, mean, scale, coef, grammar)


# ---- scoring -------------------------------------------------------------


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses) of every document: the score and how many clauses the grammar matched."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = model.features(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.of_features(rows), "clauses": np.rint(np.expm1(rows[:, 2])).astype("int64")})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInPandas(released(run), "doc_id bigint, score double, clauses bigint")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; the text itself decides, row by row."""

    @F.pandas_udf("double")
    def text_score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return released(lambda batches: (pd.Series(model.score(t)) for t in batches))(texts)

    rows = packed(docs, text=text_of())
    return unpacked(rows.filter(text_score("text") < threshold), docs)
