"""Language-model scoring with a probabilistic suffix tree over words.

The tree's root is the distribution of words; a node is a context of one or
two words.  A context is a candidate when it is seen often enough, by a count
that grows with the square root of the training tokens, and is kept when its next-word distribution diverges from
its suffix's by more than it costs to write down.  A kept context names the
words that diverge and hands the rest of its mass to its suffix; a text is
scored with the longest kept suffix of what comes before each word.

Counting is a shuffle of each task's partial counts over the whole training
set.  So the tree grows with the corpus: of N tokens at most ``contexts``
times the square root of N are contexts of a length, and ``named`` times it
contexts with a word.  That is the proven bound of what is broadcast beside
the frequent words, at most ``head`` or ``named`` times the root as well (1e13
tokens: 16 bytes for each of at most 5.1e7, 8.1e8 and 8.1e8, of which skewed
counts leave a small part).  All other words, however many, are
joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .common import staged


@dataclass(frozen=True)
class SuffixTree:
    """head: frequent words are those of at least 1 / head of all tokens, or
    as many as a word needs to be named, so there are at most ``head`` or
    ``named`` times the root; it changes the cost and not the result; contexts, named: the most contexts, and contexts
    with a word, for each root of the training tokens, which the least counts
    follow from; depth: words of the longest context (1 or 2);
    gain: nats that a kept word must save, and a kept context for each word."""

    head: int = 2_000_000
    contexts: float = 16.0
    named: float = 256.0
    depth: int = 2
    gain: float = 4.0


_END = np.uint64(0xD1B54A32D192ED03)
_COUNT_TOKENS = 6_000_000


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and where texts begin."""
    w = bytetext.words(raw, offs, bytetext.SPACED)
    texts = len(offs) - 1
    out = np.empty(len(w.hash) + texts, np.uint64)
    ends = w.first[1:] + np.arange(texts)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = w.hash
    out[ends] = _END
    return out, np.concatenate([[0], ends + 1])


def _inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bytetext.mix(context * np.uint64(3) + word)


def _contexts(tokens: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words before each token; 0 where the text
    does not have as many."""
    start = np.repeat(first[:-1], np.diff(first))
    place = np.arange(len(tokens))
    if length == 1:
        before = np.concatenate([np.zeros(1, np.uint64), tokens[:-1]])
    else:
        before = np.zeros(len(tokens), np.uint64)
        before[2:] = _join(tokens[:-2], tokens[1:-1])
    return np.where(place - start >= length, before, np.uint64(0))


def _partial_counts(keys):
    """Counts of what ``keys`` makes of a slice, summed over many slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flushed() -> pa.RecordBatch:
            context, word = (np.concatenate(x) for x in zip(*held, strict=True))
            both = _join(context, word)
            _, at, counts = np.unique(both, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(context[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(counts)], ["context", "word", "n"]
            )

        for batch in batches:
            for _, _, raw, offs in bytetext.slices(batch.column("text")):
                pair = keys(*_tokens(raw, offs))
                held.append(pair)
                n += len(pair[0])
                if n >= _COUNT_TOKENS:
                    yield flushed()
                    held, n = [], 0
        if held:
            yield flushed()

    return run


_COUNTS = "context long, word long, n long"


@dataclass(frozen=True)
class _Model:
    words: np.ndarray  # frequent words, sorted
    counts: np.ndarray
    kept: tuple[np.ndarray, np.ndarray]  # kept contexts, log10 of the mass factor handed on
    named: tuple[np.ndarray, np.ndarray]  # context with word, log10 probability


@dataclass(frozen=True)
class Root:
    """The word distribution: add-one for the base, absolute discounting for
    the model, whose freed mass is spread over an estimate of unseen words."""

    tokens: int
    types: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.0

    @property
    def unseen(self) -> float:
        types = max(1.0, self.once**2 / (2 * max(1, self.twice)))
        freed = self.discount * self.types / max(1, self.tokens)
        return max(freed, 1 / (self.tokens + self.types + 1)) / types if self.tokens else 1.0

    def model_log10(self, counts: np.ndarray) -> np.ndarray:
        known = np.log10(np.maximum(counts - self.discount, 1e-9) / max(1, self.tokens))
        return np.where(counts > 0, known, np.log10(self.unseen))

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def _kept_words(rows, suffix_log10, rule: SuffixTree):
    """Divergence tests over (context, word, n, total) rows of one length.

    suffix_log10(context index array) gives each row's probability under the
    context's suffix.  Returns kept contexts, factors, named keys, log10s.
    """
    context, word, n, total = rows
    p = (n - 0.5) / total
    q = 10.0 ** suffix_log10
    saved = n * np.log(p / q)
    keep = np.abs(saved) > rule.gain
    keys, where = np.unique(context, return_inverse=True)
    gain = np.bincount(where, np.where(keep, saved, 0.0), len(keys))
    named = np.bincount(where, keep, len(keys))
    mass_p = np.bincount(where, np.where(keep, p, 0.0), len(keys))
    mass_q = np.bincount(where, np.where(keep, q, 0.0), len(keys))
    good = (named > 0) & (gain > rule.gain * named) & (mass_p < 1) & (mass_q < 1 - 1e-6)
    keep &= good[where]
    factor = np.log10((1 - mass_p[good]) / (1 - mass_q[good]))
    pair = _join(context[keep], word[keep])
    return keys[good], factor, pair, np.log10(p[keep])


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _log10_given(model: _Model, root_log10: np.ndarray, contexts: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """log10 probability by the longest kept suffix; contexts: shorter first."""
    out = root_log10
    for context in contexts:
        at = _inside(context, model.kept[0])
        live = np.flatnonzero(at >= 0)
        if len(live):
            out = out.copy()
            said = _inside(_join(context[live], word[live]), model.named[0])
            handed = out[live] + model.kept[1][at[live]]
            out[live] = np.where(said >= 0, model.named[1][np.maximum(said, 0)], handed) if len(model.named[0]) else handed
    return out


def _collected(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toPandas()
    return [table[c].to_numpy(np.int64) for c in names]


def scored(docs: DataFrame, is_training: Column, rule: SuffixTree = SuffixTree()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text).

    Learns from the rows where ``is_training`` holds (null does not).  Null
    and empty texts are one end token; repeated rows are counted and scored
    each; other columns are ignored; no rows give no rows, and with no
    training rows every token is unseen.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_training.alias("training")
    )
    training = rows.where("training").select("text")
    none = np.zeros(0, np.uint64)

    words = training.mapInArrow(_partial_counts(lambda t, first: (np.zeros(len(t), np.uint64), t)), _COUNTS)
    words = staged(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    told = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    ).first()
    root = Root(*map(int, told))
    least = max(10, int(np.ceil(root.tokens**0.5 / rule.contexts)))
    joint = max(3, int(np.ceil(root.tokens**0.5 / rule.named)))
    # A word that a context may name or that is one is frequent, whatever
    # ``head`` says: it only chooses who is joined by a shuffle.
    floor = min(max(1, -(-root.tokens // rule.head)), joint, least)
    head, counts = _collected(words.where(F.col("n") >= floor), "word", "n")
    head, counts = _sorted(head.view(np.uint64), counts)
    log10 = root.model_log10(counts)

    model = _Model(head, counts, (none, np.zeros(0)), (none, np.zeros(0)))
    candidates = np.sort(head[(counts >= least) & (head != _END)])
    totals = dict(zip(head[counts >= least].tolist(), counts[counts >= least].tolist(), strict=True))
    for length in range(1, rule.depth + 1):
        if not len(candidates):
            break
        held = spark.sparkContext.broadcast((head, candidates, length))

        def pairs(t: np.ndarray, first: np.ndarray, held=held) -> tuple[np.ndarray, np.ndarray]:
            frequent, asked, n = held.value
            context = _contexts(t, first, n)
            at = np.flatnonzero(_inside(context, asked) >= 0)
            at = at[_inside(t[at], frequent) >= 0]
            return context[at], t[at]

        found = training.mapInArrow(_partial_counts(pairs), _COUNTS).groupBy("context", "word").agg(F.sum("n").alias("n"))
        context, word, n = _collected(found.where(F.col("n") >= joint), "context", "word", "n")
        context, word = context.view(np.uint64), word.view(np.uint64)
        total = np.array([totals[c] for c in context.tolist()], float)
        below = log10[_inside(word, head)]
        if length == 2:
            below = _log10_given(model, below, [last_word[_inside(context, two)]], word) if len(context) else below
        kept, factor, named, given = _kept_words((context, word, n, total), below, rule)
        model = _Model(
            head,
            counts,
            _sorted(np.concatenate([model.kept[0], kept]), np.concatenate([model.kept[1], factor])),
            _sorted(np.concatenate([model.named[0], named]), np.concatenate([model.named[1], given])),
        )
        # The next length: contexts that are themselves frequent.
        deep = (n >= least) & (word != _END)
        longer = _join(context[deep], word[deep])
        two, order = np.unique(longer, return_index=True)
        last_word = word[deep][order]
        totals = dict(zip(longer.tolist(), n[deep].tolist(), strict=True))
        candidates = two

    held_model = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held_model.value
        known_model, known_base = root.model_log10(m.counts), root.base_log10(m.counts)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, raw, offs in bytetext.slices(batch.column("text")):
                t, first = _tokens(raw, offs)
                where = _inside(t, m.words)
                seen = where >= 0
                # Rare words add their root's part after the join.
                own = np.where(seen, known_model[where] if len(known_model) else 0.0, 0.0)
                base = np.where(seen, known_base[where] if len(known_base) else 0.0, 0.0)
                own = _log10_given(m, own, [_contexts(t, first, k) for k in range(1, rule.depth + 1)], t)
                rare = np.flatnonzero(~seen)
                cut = np.searchsorted(rare, first).astype(np.int32)
                sums = [np.add.reduceat(x, first[:-1]) for x in (own, base, seen.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, to - at),
                        pa.array(np.diff(first)),
                        pa.array(sums[2]),
                        pa.array(sums[1]),
                        pa.array(sums[0]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(t[rare].view(np.int64))),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base", "own", "rare"],
                )

    parts = rows.select("doc_id", "text").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base double, own double, rare array<long>"
    )
    parts = staged(parts.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = parts.where("size(rare) > 0").select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    n = F.coalesce("n", F.lit(0))
    model_rare = F.when(n > 0, F.log10((n - root.discount) / max(1, root.tokens))).otherwise(float(np.log10(root.unseen)))
    base_rare = F.log10((n + 1) / float(root.tokens + root.types + 1))
    late = (
        rare.join(words.where(F.col("n") < floor), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("late_known"),
            F.sum(F.col("times") * base_rare).alias("late_base"),
            F.sum(F.col("times") * model_rare).alias("late_own"),
        )
    )
    zero = F.lit(0.0)
    return parts.drop("rare").join(late, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(root.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("late_own", zero)).alias("score"),
    )
