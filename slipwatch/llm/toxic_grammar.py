"""Toxicity by a weighted finite-state grammar over clauses.

A tagger gives each word of a clause a tag: insult and threat words and stems with weights
learned from labels, and fixed words of address, negation and reported speech. Transducers
for insult, threat, target, negation and report read the tags side by side; their
composition is built lazily, state by state, and tells for every insult or threat in which
reading it stands, as soon as the clause is over: an address may follow the insult. A comma
or colon ends a clause but not the report it stands in. A clause scores the weights of its
matches by reading; a logistic model of the clause scores, fitted on the same labelled
sample, turns them into a probability.

Defined results: null and empty texts match nothing and get the score of a text without
matches; with no labels of both classes every score is 0; repeated label rows of one
document count as toxic if any says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_CLASS = 6000  # labelled documents per class, the first by a hash of the id
LEXICON = 3000  # learned words and stems at most
STEMS = (4, 5, 6)
LEAST_ODDS, LEAST_DOCS = 2.5, 5
NEGATION_REACH = 3

# Words that steer the grammar, in the languages of the tables.
TARGETS = frozenset("you your you're u he she they him her them his their this these those du dich dir dein deine ihr euch er sie tu toi te vous il elle ils elles lui tú usted ustedes él ella ellos eres".split())
NEGATIONS = frozenset("not no never none nor isn't aren't don't doesn't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás tampoco ningún ninguna".split())
REPORTS = frozenset("said says say wrote called calls quoted reported claimed according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split())
THREATS = frozenset("kill hurt destroy beat burn shoot attack töten schlagen zerstören tuer frapper détruire matar golpear destruir".split())

CLAUSE = re.compile(r"([.!?;:,\n()](?:\s*[.!?;:,\n()])*)")
CARRIES = frozenset(",: \t\r\n")  # a separator of these alone, with a comma or colon, carries the report on
TOKEN = re.compile(r"[\w'’]+")

READINGS = ("plain", "aimed", "negated", "reported", "threat")
FEATURES = (*READINGS, "clauses", "strongest")


def tag_class(word: str) -> str:
    return (
        "T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "H" if word in THREATS else "O"
    )


# Each transducer maps (state, tag) to the next state; what it says of a match follows from the state.
def insult_step(state: int, tag: str) -> int:
    return int(tag == "I")


def threat_step(state: int, tag: str) -> int:
    return int(tag == "H")


def target_step(state: int, tag: str) -> int:
    return 1 if tag == "T" else state


def negation_step(state: int, tag: str) -> int:
    return NEGATION_REACH if tag == "N" else max(0, state - 1)


def report_step(state: int, tag: str) -> int:
    return 1 if tag == "R" else state


State = tuple[int, int, int, int, int]
Match = tuple[str, bool]  # the reading but for the target, and whether it is a threat's


class Composed:
    """The transducers side by side; transitions are made once and kept (a few dozen states)."""

    steps = (insult_step, threat_step, target_step, negation_step, report_step)

    def __init__(self) -> None:
        self.arcs: dict[tuple[State, str], tuple[State, Match | None]] = {}

    @staticmethod
    def start(reported: int = 0) -> State:
        return (0, 0, 0, 0, reported)

    def step(self, state: State, tag: str) -> tuple[State, Match | None]:
        arc = self.arcs.get((state, tag))
        if arc is None:
            after = tuple(f(s, tag) for f, s in zip(self.steps, state, strict=True))
            _, _, _, negated, reported = state
            insult, threat, *_ = after
            match = None
            if insult or threat:
                match = ("reported" if reported else "negated" if negated else "plain", bool(threat))
            arc = self.arcs[state, tag] = (after, match)
        return arc

    @staticmethod
    def reading(match: Match, end: State) -> str | None:
        """How a match reads at the end of its clause; an act without a target is no threat."""
        found, threat = match
        if found != "plain":
            return found
        if threat:
            return "threat" if end[2] else None
        return "aimed" if end[2] else "plain"


@dataclass
class ToxicModel:
    """Learned weights of words and stems, and the logistic model over FEATURES."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf
    slopes: tuple[float, ...] = (0.0,) * len(FEATURES)

    def __post_init__(self) -> None:
        self._grammar = Composed()
        self._finder = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS]:
            self._finder.add_word(w, len(w))
        self._finder.make_automaton()

    def __reduce__(self):
        return ToxicModel, (self.words, self.stems, self.bias, self.slopes)

    def weight(self, word: str) -> float:
        """The learned weight of an insult, 0 for any other word."""
        if (w := self.words.get(word)) is not None:
            return w
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)

    def clause(self, text: str, reported: int = 0) -> dict[str, float]:
        """Summed weights of a clause's matches by reading."""
        return self._read(text, reported)[0]

    def _read(self, text: str, reported: int) -> tuple[dict[str, float], int]:
        """The sums of a clause, and the report transducer's state at its end."""
        state, matches, found = self._grammar.start(reported), [], {}
        for t in TOKEN.findall(text):
            w = self.weight(t)
            tag = "I" if w > 0 else tag_class(t)
            state, match = self._grammar.step(state, tag)
            if match:
                matches.append((match, w or 1.0))
        for match, w in matches:
            reading = self._grammar.reading(match, state)
            if reading:
                found[reading] = found.get(reading, 0.0) + w
        return found, state[4]

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        if not low or next(self._finder.iter(low), None) is None:
            return [0.0] * len(FEATURES)
        sums, clauses, strongest = dict.fromkeys(READINGS, 0.0), 0, 0.0
        reported, unread = 0, []  # the report so far, and clauses without a match that may begin one
        pieces = CLAUSE.split(low)
        for part, mark in zip(pieces[::2], [*pieces[1::2], "."], strict=True):
            if next(self._finder.iter(part), None) is None:
                unread.append(part)
            else:
                for t in (t for p in unread for t in TOKEN.findall(p)):
                    reported = report_step(reported, tag_class(t))
                unread = []
                found, reported = self._read(part, reported)
                if found:
                    clauses += 1
                    strongest = max(strongest, sum(found.values()))
                    for k, v in found.items():
                        sums[k] += v
            if not CARRIES.issuperset(mark) or not ("," in mark or ":" in mark):
                reported, unread = 0, []
        return [*(math.log1p(sums[k]) for k in READINGS), math.log1p(clauses), math.log1p(strongest)]

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, features, strict=True))
        return 0.0 if z < -700 else 1.0 / (1.0 + math.exp(-z))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Up to `per_class` labelled documents of each class, the first by a hash of the id.

    The ids of the sample are at most twice `per_class`, so they are broadcast and no text is shuffled.
    """
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    part = [
        ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    return docs.select("doc_id", "text").join(F.broadcast(part[0].unionByName(part[1])), "doc_id").select("text", "toxic")


def _terms(text: str) -> set[str]:
    """Words as they are, stems with a star."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, lexicon: int = LEXICON) -> ToxicModel:
    """Weights and logistic model from a bounded sample of labelled documents (columns doc_id, text; doc_id, toxic).

    Terms are counted on the cluster; the driver gets at most `lexicon` of them and, for the
    logistic model, the seven features of the sample.
    """
    sizes = {r["toxic"]: r["n"] for r in labels.filter("toxic is not null").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicModel()
    sample = _sample(docs, labels, per_class)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for part in parts:
            for text, y in zip(part["text"].fillna(""), part["toxic"], strict=True):
                sums[int(y)].update(_terms(text))
                n[int(y)] += 1
        for y in (0, 1):
            yield pd.DataFrame({"term": [*sums[y], ""], "y": y, "n": [*sums[y].values(), n[y]]})

    counted = (
        sample.mapInPandas(count, "term string, y int, n long")
        .groupBy("term").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(y = 0, n, 0)")).alias("good"))
    )
    seen = counted.filter("term = ''").first()
    if seen is None or not seen["bad"] or not seen["good"]:
        return ToxicModel()
    odds = F.log((F.col("bad") + 0.5) / (seen["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (seen["good"] + 1.0))
    best = (
        counted.filter((F.col("term") != "") & (F.col("bad") >= max(2, min(LEAST_DOCS, seen["bad"] // 20))))
        .withColumn("w", odds).filter(F.col("w") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("w") * F.sqrt("bad")), "term").limit(lexicon).collect()
    )
    words = {r["term"]: r["w"] for r in best if not r["term"].endswith("*")}
    stems = {r["term"][:-1]: r["w"] for r in best if r["term"].endswith("*")}
    model = ToxicModel(words, stems)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def describe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shared.value.features(t) for t in texts], dtype=object)

    rows = sample.select("toxic", describe("text").alias("f")).collect()
    x = np.array([[1.0, *r["f"]] for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    beta = _logistic(x, y)
    # The sample holds other shares of the classes than the labels do.
    shift = math.log(sizes[1] / sizes[0]) - math.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return ToxicModel(words, stems, float(beta[0]) + shift, tuple(float(b) for b in beta[1:]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    order = np.lexsort([*x.T, y])  # the same sum whatever order the rows came in
    x, y = x[order], y[order]
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 from 0.5) and readings (the features); other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, readings array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            found = [own.features(t) for t in texts]
            scores = [own.score(f) for f in found]
            yield pd.DataFrame({"score": scores, "predicted": [int(s >= 0.5) for s in scores], "readings": found})

    names = ("score", "predicted", "readings")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, run(F.col(f"`{text}`")).alias("_tox")).select(*kept, "_tox.*")
