"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as symbols: insult, threat, target (who is addressed), negation, reported speech, or
none of these. Three small transducers weigh an insult or threat by what stands before it in its
clause: a negation takes most of its weight, reported speech some, and a target adds to it. Two more
weigh what the patterns themselves do: an insult after another in its clause weighs less, and a threat
that is announced ("will") more. The five are composed; their composition is one deterministic machine, and a clause scores the sum of its patterns' weights as that
machine passes them on. Patterns are words or beginnings of words: a short list, and those that the
labelled documents teach. A document's score is a logistic function of its clauses' scores.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_LABELLED, held_out, labelled_sample

#: Words that the transducers know before any are learned.
WORDS = {
    "insult": "idiot moron stupid loser scum trash worthless pathetic disgusting clown idiota estúpido basura imbécile crétin ordure dummkopf abschaum",
    "threat": "kill hurt destroy murder strangle shoot töten umbringen tuer frapper matar golpear",
    "target": "you your yours yourself they he she du dich dein ihr euch sie tu toi vous votre ton tú tu usted ustedes",
    "negation": "not no never none nobody neither nor without nicht kein keine nie pas jamais ni sans nunca jamás ningún",
    "intent": "will shall gonna going must werde wirst vais va voy vamos",
    "reported": "said says wrote writes told claimed quoted called calls sagte schrieb behauptete dit disait écrit dijo dice escribió",
}
#: What a negation reaches over, and how each transducer weighs.
NEGATION_WORDS, NEGATED, REPORTED, TARGETED, REPEATED, INTENDED = 3, 0.25, 0.5, 1.25, 0.75, 1.5
#: A pattern is learned if so many labelled documents (near copies counted once) have it, at these log-odds at least.
MIN_DOCUMENTS, MIN_LOG_ODDS = 4, 3.0
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
LISTED_WEIGHT = 4.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """Deterministic, over symbols; an arc gives the next state and the factor of a pattern's weight."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, float]]

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "")) or (state, 1.0)


def negation() -> Transducer:
    """States: words that a negation still reaches."""
    arcs: dict[tuple[int, str], tuple[int, float]] = {}
    for s in range(NEGATION_WORDS + 1):
        arcs[s, ""] = (max(0, s - 1), 1.0)
        arcs[s, "negation"] = (NEGATION_WORDS, 1.0)
        for p in ("insult", "threat"):
            arcs[s, p] = (max(0, s - 1), NEGATED if s else 1.0)
    return Transducer(0, arcs)


def flag(symbol: str, factor: float) -> Transducer:
    """State 1 once ``symbol`` has been read: patterns then weigh ``factor`` times as much."""
    return Transducer(0, {(0, symbol): (1, 1.0), (1, "insult"): (1, factor), (1, "threat"): (1, factor)})


def insult(factor: float = REPEATED) -> Transducer:
    """State 1 once an insult has been read: the next ones add less."""
    return Transducer(0, {(0, "insult"): (1, 1.0), (1, "insult"): (1, factor)})


def threat(factor: float = INTENDED) -> Transducer:
    """State 1 once an intent has been read: threats then weigh more."""
    return Transducer(0, {(0, "intent"): (1, 1.0), (1, "threat"): (1, factor)})


def compose(*parts: Transducer) -> Transducer:
    """The product machine: all parts read the same symbols, and their factors multiply."""
    symbols = [*WORDS, ""]
    reached, todo, arcs = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)], {}
    while todo:
        states = todo.pop()
        for symbol in symbols:
            steps = [p.step(s, symbol) for p, s in zip(parts, states, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in reached:
                reached[after] = len(reached)
                todo.append(after)
            arcs[reached[states], symbol] = (reached[after], float(np.prod([f for _, f in steps])))
    return Transducer(0, arcs)


@dataclass
class Grammar:
    """patterns: (text, whether only its beginning counts) -> (symbol, weight); logistic: weights of FEATURES and a constant."""

    patterns: dict[tuple[str, bool], tuple[str, float]]
    logistic: tuple[float, ...] = (1.0, 0.5, 0.0, -3.0)
    machine: Transducer = field(default_factory=lambda: compose(insult(), threat(), negation(), flag("reported", REPORTED), flag("target", TARGETED)))

    def __post_init__(self):
        self._symbols = {w: s for s in ("target", "negation", "intent", "reported") for w in WORDS[s].split()}
        self._finder = ahocorasick.Automaton()
        for (text, begins), (symbol, weight) in self.patterns.items():
            self._finder.add_word(text, (*self._finder.get(text, ()), (len(text), begins, symbol, weight)))
        if len(self._finder):
            self._finder.make_automaton()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each clause of the lower-cased text that has a pattern."""
        if not len(self._finder):
            return []
        hits: dict[int, tuple[str, float]] = {}
        for end, found in self._finder.iter(text):
            for size, begins, symbol, weight in found:
                start, after = end + 1 - size, end + 1
                if (start and text[start - 1].isalpha()) or (not begins and after < len(text) and text[after].isalpha()):
                    continue
                if start not in hits or hits[start][1] < weight:
                    hits[start] = symbol, weight
        out, done = [], -1
        for at in sorted(hits):
            if at < done:
                continue
            low = max(done, 0)  # no clause reaches back over the end of the one before, so each character is looked at once
            start = max(text.rfind(c, low, at) for c in ".!?;:\n")
            start = start + 1 if start >= 0 else low
            close = CLAUSE_END.search(text, at)
            done = close.start() if close else len(text)
            state, score, step = self.machine.start, 0.0, self.machine.arcs
            for word in WORD.finditer(text, start, done):
                symbol, weight = hits.get(word.start()) or (self._symbols.get(word.group(), ""), 0.0)
                state, factor = step[state, symbol]
                score += weight * factor
            out.append((start, done, score))
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Log of the clauses' sum, the strongest clause, and log of the sum for each thousand characters."""
        scores = [s for _, _, s in self.clauses(text.lower())]
        total = sum(scores)
        return float(np.log1p(total)), min(max(scores, default=0.0), 8.0), float(np.log1p(1000 * total / (len(text) + 200)))

    def score(self, text: str | None) -> float:
        *weights, constant = self.logistic
        z = sum(w * x for w, x in zip(weights, self.features(text or ""), strict=True)) + constant
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _signature(words: set[str]) -> int:
    """Near copies of a text mostly share it: the hash of its least word hashes."""
    return hash(tuple(sorted(pd.util.hash_array(np.array(sorted(words), dtype=object)).tolist())[:2])) if words else 0


def learn_patterns(sample: DataFrame) -> dict[tuple[str, bool], tuple[str, float]]:
    """Words and word beginnings of (text, y) rows that mark label 1; of patterns that begin alike, the shortest,
    spelled out as far as no document is lost.

    The counts are made on Spark; all patterns that pass reach the driver, which the sample bounds.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = set(WORD.findall(text.lower()))
                found = {(w, False) for w in words} | {(w[:k], True) for w in words for k in PREFIX_LENGTHS if len(w) >= k}
                if found:
                    yield pd.DataFrame({"pattern": [p for p, _ in found], "begins": [b for _, b in found], "y": y, "signature": _signature(words)})

    each = sample.mapInPandas(spread, "pattern string, begins boolean, y int, signature long")
    counted = each.groupBy("pattern", "begins", "signature").agg(F.max("y").alias("y")).groupBy("pattern", "begins").agg(F.sum("y").alias("hit"), F.sum(1 - F.col("y")).alias("miss"))
    size = sample.agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = float(size.y or 0), float((size.n or 0) - (size.y or 0))
    odds = F.log((F.col("hit") + 0.5) / (ones + 1)) - F.log((F.col("miss") + 0.5) / (zeros + 1))
    rows = counted.withColumn("odds", odds).filter((F.col("hit") >= MIN_DOCUMENTS) & (F.col("odds") >= MIN_LOG_ODDS)).collect()
    listed = sorted(rows, key=lambda r: (r.pattern, r.begins))
    spelled = [r.pattern for r in listed]
    shortest: set[str] = set()
    kept: dict[tuple[str, bool], tuple[str, float]] = {}
    for row in sorted(listed, key=lambda r: (len(r.pattern), not r.begins)):
        if not any(row.pattern[:k] in shortest for k in PREFIX_LENGTHS if k <= len(row.pattern)):
            longer = listed[bisect_left(spelled, row.pattern) : bisect_right(spelled, row.pattern + chr(0x10FFFF))] if row.begins else [row]
            longest = max((r for r in longer if r.hit >= row.hit and r.miss <= row.miss), key=lambda r: (len(r.pattern), not r.begins, r.pattern))
            kept[longest.pattern, longest.begins] = "insult", min(float(longest.odds), 8.0)
            if row.begins:
                shortest.add(row.pattern)
    return kept


def fit_grammar(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Grammar:
    """Learn patterns and the logistic function from at most ``limit`` labelled documents that are not held out.

    Without labels of both kinds the listed patterns and a fixed function remain.
    """
    sample = labelled_sample(docs, labels, "toxic", limit).persist()
    listed = {(w, False): (s, LISTED_WEIGHT) for s in ("insult", "threat") for w in WORDS[s].split()}
    grammar = Grammar(listed | learn_patterns(sample))

    patterns = grammar.patterns

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grammar(patterns)
        for batch in batches:
            yield pd.DataFrame([(*own.features(t), float(y)) for t, y in zip(batch["text"], batch["y"], strict=True)], columns=list("abcy"))

    rows = sample.mapInPandas(measure, "a double, b double, c double, y double").toPandas().to_numpy(float)  # a row of four numbers for each document of the sample
    sample.unpersist()
    if len(rows) and 0 < rows[:, 3].sum() < len(rows):
        grammar = Grammar(grammar.patterns, _logistic(rows[:, :3], rows[:, 3]))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method with a ridge penalty; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score_toxicity(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    Null and empty texts have no clauses and get the constant's score. Rows are scored one by one, so
    repeated rows score alike; an empty table gives no rows; other columns are ignored.
    """
    parts = (grammar.patterns, grammar.logistic)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grammar(*parts)
        for batch in batches:
            scores = np.array([own.score(t) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "score": scores, "predicted": (scores >= threshold).astype("int32")})

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
