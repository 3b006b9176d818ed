"""Toxicity by a weighted finite-state pattern grammar.

Words are put into symbols by finite-state word patterns (whole words and word
beginnings).  Five transducers read the symbols of a clause: insults (one word
or several), threats (intent, verb and target in order), targets on
either side, negation with a short scope, and reported speech from its verb to
the end of the clause.  They are composed into one machine, which gives at the
end of each clause one event: what was matched and what stands around it.
Clauses are scored, not words, and a text by the sums of its clauses of each
degree, their rate and its worst threat.

Word patterns of insults and the weights of the clause scores are learned from
labelled documents; the closed classes and what a target, a negation or a
report does to a clause are fixed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .common import staged

#: Closed classes in the languages of the corpus.
NEGATIONS = "not never no nor without cannot kein keine nicht nie ohne pas jamais sans non nunca jamás sin".split()
REPORTS = "said says wrote called claimed alleged quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
TARGETS = "you your he she they him her them it du dich ihr sie er vous tu toi il elle ils usted tú él ella ellos".split()
THREATS = "kill hurt destroy beat attack shoot stab töten schlagen tuer frapper matar golpear".split()
INTENTS = "will shall gonna going werde werden wollen vais allons voy vamos".split()

#: Symbols. Insults have three strengths.
OTHER, MILD, MEDIUM, STRONG, THREAT, INTENT, TARGET, NEGATION, REPORT, BREAK = range(10)
SYMBOLS = 10
NEGATED_WORDS = 3
#: Words after which a clause without a mark at its end is over.
CLAUSE_WORDS = 40

#: What a threat of each state weighs, and what a target, a negation and a
#: report make of a clause.
THREATENED = (0.0, 0.0, 0.25, 0.5, 1.0, 3.0)
TARGETED, NEGATED, REPORTED = 1.5, 0.5, 0.3

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]")
_PREFIXES = range(3, 11)


@dataclass(frozen=True)
class ToxicityTraining:
    """sample: most labelled documents used to fit (the bound is part of the
    method: fitting is on the driver); doubt: the chance that any pattern of
    clean words passes the test; pure: the least share of toxic documents
    among those with a pattern; strong, medium: shares from which an insult
    has that strength."""

    sample: int = 20_000
    doubt: float = 0.01
    pure: float = 0.7
    strong: float = 0.97
    medium: float = 0.85


# --- transducers: (state, symbol) -> state, within one clause ------------------


def _insult(state, symbol):
    """Degree so far: further insults of the clause raise it by one each."""
    if symbol in (MILD, MEDIUM, STRONG):
        return min(3, max(state, symbol) + (state > 0))
    return state


def _threat(state, symbol):
    """0 nothing, 1 intent, 2 verb, 3 intent and verb, 4 and 5 these with a
    target after them."""
    if symbol == INTENT:
        return max(state, 1)
    if symbol == THREAT:
        return {0: 2, 1: 3}.get(state, state)
    if symbol == TARGET:
        return {2: 4, 3: 5}.get(state, state)
    return state


def _target(state, symbol):
    return 1 if symbol == TARGET else state


def _hit(symbol):
    return symbol in (MILD, MEDIUM, STRONG, THREAT)


def _negation(state, symbol):
    """Words left in the scope, and whether a match stood outside of any."""
    left, plain = state
    if symbol == NEGATION:
        return NEGATED_WORDS, plain
    return max(0, left - 1), 1 if _hit(symbol) and not left else plain


def _report(state, symbol):
    """0 nothing, 1 a verb of speech before any match, 2 a match before it."""
    return state if state else 1 if symbol == REPORT else 2 if _hit(symbol) else 0


MACHINES = (_insult, _threat, _target, _negation, _report)
START = (0, 0, 0, (0, 0), 0)


def _clause(state) -> tuple[int, float, float]:
    """Degree and weight of the insult and weight of the threat of a clause
    that ends here."""
    degree, threat, target, (_, plain), report = state
    around = (1.0 if plain else NEGATED) * (REPORTED if report == 1 else 1.0)
    return degree, (TARGETED if target else 1.0) * around, THREATENED[threat] * around


def compose() -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """The composed machine: next states by symbol, and each state's clause."""
    number, queue, rows = {START: 0}, deque([START]), []
    while queue:
        state = queue.popleft()
        row = []
        for symbol in range(SYMBOLS):
            to = START if symbol == BREAK else tuple(m(s, symbol) for m, s in zip(MACHINES, state, strict=True))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    return np.array(rows), [_clause(state) for state in number]


NEXT, CLAUSES = compose()
_NEXT = NEXT.tolist()


class Grammar:
    """Word patterns and the machine; measures the clauses of texts."""

    KEPT = 300_000

    def __init__(self, patterns: dict[str, int]):
        """patterns: ``word`` or ``beginning*`` to a symbol."""
        self.words = {w: s for w, s in patterns.items() if not w.endswith("*")}
        for words, symbol in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET), (THREATS, THREAT), (INTENTS, INTENT)):
            for w in words:
                self.words[w] = symbol
        for c in ".!?;\n":
            self.words[c] = BREAK
        self.beginnings = {w[:-1]: s for w, s in patterns.items() if w.endswith("*")}
        self.kept: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        if word in self.words:
            return self.words[word]
        return next((self.beginnings[word[:k]] for k in _PREFIXES if k <= len(word) and word[:k] in self.beginnings), OTHER)

    def features(self, text: str) -> np.ndarray:
        tokens = _TOKENS.findall(text.lower())
        symbols = list(map(self.kept.get, tokens))
        if None in symbols:
            if len(self.kept) > self.KEPT:
                self.kept.clear()
            symbols = [self.kept.setdefault(t, self.symbol(t)) if s is None else s for t, s in zip(tokens, symbols, strict=True)]
        codes = np.array(symbols, np.int8)
        at = np.flatnonzero(codes)
        insults, worst = [0.0] * 4, 0.0
        state, last, begun = 0, -1, 0
        for place, symbol in zip([*at.tolist(), len(tokens)], [*codes[at].tolist(), BREAK], strict=True):
            over = symbol == BREAK or place - begun >= CLAUSE_WORDS
            if over:
                degree, insult, threat = CLAUSES[state]
                insults[degree] += insult
                worst = max(worst, threat)
                state, begun = 0, place
            else:
                for _ in range(min(place - last - 1, NEGATED_WORDS)):
                    state = _NEXT[state][OTHER]
            state, last = _NEXT[state][symbol], place
        rate = np.log1p(1000 * sum(insults[1:]) / max(1, len(tokens)))
        return np.array([*np.log1p(insults[1:]), rate, worst])


FEATURES = 5


@dataclass(frozen=True)
class ToxicityModel:
    patterns: dict[str, int]
    weights: np.ndarray  # the last one is the bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _voice(words: list[str]) -> int:
    """The least hash of five words in a row: copies and near copies of a
    text mostly share it, so that they count once as evidence."""
    return min((zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))), default=0)


def _voices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        worker.kept("toxicity")
        texts = batch.column("text").to_pylist()
        voices = [_voice([w for w in _TOKENS.findall((t or "").lower()) if w.isalpha()]) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(voices, pa.int64())], ["doc_id", "toxic", "voice"]
        )


def _word_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct words and word beginnings, with its label."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = [w for w in _TOKENS.findall((text or "").lower()) if w.isalpha()]
            found = set(words)
            found.update([f"{w[:k]}*" for w in found for k in _PREFIXES if k <= len(w)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([toxic] * len(found), pa.int32())], ["pattern", "toxic"]
            )


#: What the clause scores weigh where the labels say nothing of them.
PRIOR = (0.5, 1.0, 2.0, 0.0, 1.0)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, around ``PRIOR``.

    A feature that would lower the score of a worse clause is left out.
    """
    live = list(range(x.shape[1]))
    prior = np.array([*PRIOR, 0.0])
    while True:
        own = np.column_stack([x[:, live], np.ones(len(x))])
        centre = prior[[*live, -1]]
        w = centre.copy()
        ridge = np.full(len(w), 0.5)
        ridge[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient = own.T @ (p - y) + ridge * (w - centre)
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + np.diag(ridge), gradient)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            weights = np.zeros(x.shape[1] + 1)
            weights[[*live, -1]] = w
            return weights
        live.pop(int(np.argmin(w[:-1])))


def train(docs: DataFrame, labels: DataFrame, rule: ToxicityTraining = ToxicityTraining()) -> ToxicityModel:
    """Learn from documents (doc_id, text) with labels (doc_id, toxic).

    Of more than ``sample`` labels those whose hashed ids are smallest serve,
    a sample that is the same on every run.  Without a toxic or without a
    clean label nothing is learned and every score is the share of toxic ones.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(rule.sample)
    )
    rows = chosen.collect()  # at most ``sample`` pairs of integers
    chosen = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    patterns: dict[str, int] = {}
    toxic = sum(r[1] for r in rows)
    if 0 < toxic < len(rows):
        share = toxic / len(rows)
        voices = sample.mapInArrow(_voices, "doc_id long, toxic int, voice long").groupBy("toxic", "voice").agg(F.min("doc_id").alias("doc_id"))
        heard = spark.createDataFrame(voices.select("doc_id").collect(), "doc_id long")  # at most ``sample`` integers
        found = (
            sample.join(F.broadcast(heard), "doc_id", "left_semi")
            .mapInArrow(_word_patterns, "pattern string, toxic int")
            .groupBy("pattern")
            .agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
            .where("n > 1")
        )
        found = staged(found, "patterns")
        # Chernoff's bound on as many hits by chance, over all patterns that
        # occur often enough to pass at all.
        part = F.col("hits") / F.col("n")
        clean = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
        bound = F.col("n") * (part * F.log(part / share) + clean)
        sizes = found.groupBy("n").count().collect()  # at most a row for each labelled document
        least, tested = math.log(1 / rule.doubt), 0
        for n, patterns_of_size in sorted(sizes, reverse=True):
            if n * -math.log(share) <= least:
                break
            tested += patterns_of_size
            least = math.log(tested / rule.doubt)
        found = found.where((part >= max(rule.pure, share)) & (bound > least)).orderBy("pattern").collect()
        purity = {r[0]: (r[1] - 0.5) / r[2] for r in found}
        hits = {r[0]: r[1] for r in found}
        # A beginning that one longer pattern almost accounts for is too wide.
        longest: dict[str, int] = {}
        for p in hits:
            word = p.rstrip("*")
            for k in _PREFIXES:
                if k < len(word) or (k == len(word) and p == word):
                    q = f"{word[:k]}*"
                    longest[q] = max(longest.get(q, 0), hits[p])
        narrow = [p for p in hits if hits[p] * 0.9 > longest.get(p, 0)]
        for p in sorted(narrow, key=lambda p: (len(p.rstrip("*")), p)):
            word = p.rstrip("*")
            shorter = [f"{word[:k]}*" for k in _PREFIXES if k < len(word)]
            if not any(q in patterns and purity[q] >= purity[p] - 0.05 for q in shorter):
                patterns[p] = STRONG if purity[p] >= rule.strong else MEDIUM if purity[p] >= rule.medium else MILD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(patterns)
        for batch in batches:
            x = [grammar.features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    weights = np.zeros(FEATURES + 1)
    if rows:
        share = (toxic + 0.5) / (len(rows) + 1)
        weights[-1] = np.log(share / (1 - share))
    if patterns:
        got = sample.mapInArrow(run, "x array<double>, toxic int").toPandas()
        weights = _fit(np.array(got["x"].tolist()), got["toxic"].to_numpy(float))
    return ToxicityModel(patterns, weights)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with ``_score`` (0 to 1) and ``_toxic`` (score >= 0.5).

    Null and empty texts score as a text without a match; repeated rows score
    alike; all columns of docs are kept, but for its own columns of these two
    names, which are replaced; doc_id is not read; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker.kept("toxicity")
        grammar = Grammar(held.value.patterns)
        for part in texts:
            features = [grammar.features(t or "") for t in part]
            yield pd.Series(held.value.score(np.array(features)) if features else [], dtype=float)

    return docs.withColumn("_score", score(F.col("text").cast("string"))).withColumn("_toxic", F.col("_score") >= 0.5)
