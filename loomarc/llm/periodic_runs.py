"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q that is at
least ``min_words`` and ``repeats * q`` words long and that no neighbouring
word extends.  Each of its words stands in it ``repeats`` times or more, so a
word that a segment holds less often lies in no run of that segment and splits
it.  The parts are counted again, and split again, until no word splits.  The
surviving segments are scanned lag by lag: stretches in which words ``q`` apart
are identical.

Most lags need no scan.  Let k be a power of two with k / 2 < q <= k.  A run's
k consecutive words come again exactly q words later and not before, as its
period is the smallest one, and it is long enough for that (k < 2 q).  So only
distances at which some k-gram follows its last occurrence are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows


@dataclass(frozen=True)
class RunRules:
    """Least words of a run, and least repeats of its period (3 or more: with
    fewer, a run may be shorter than the k-grams that tell its lag)."""

    min_words: int = 24
    repeats: int = 3

    def __post_init__(self) -> None:
        if self.repeats < 3:
            raise ValueError("repeats must be 3 or more")


def _segments(words: np.ndarray, rules: RunRules) -> Iterator[tuple[int, int]]:
    """Bounds of the segments in which no word is rare, by repeated splits."""
    waiting = [(0, len(words))]
    while waiting:
        a, b = waiting.pop()
        if b - a < rules.min_words:
            continue
        part = words[a:b]
        if b - a < len(words) // 4:  # small ids, so that counting costs no more than the part
            part = np.unique(part, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < rules.repeats)
        if not len(rare):
            yield a, b
            continue
        cuts = np.concatenate([[-1], rare, [b - a]])
        for k in np.flatnonzero(np.diff(cuts) > rules.min_words):
            waiting.append((a + int(cuts[k]) + 1, a + int(cuts[k + 1])))


def _lags(part: np.ndarray, longest: int) -> list[int]:
    """Lags up to ``longest`` at which some run of the segment may repeat."""
    lags: set[int] = set()
    grams, k = part.astype(np.int64), 1
    while True:
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            break  # no k words come again, so no more words do
        apart = (order[1:] - order[:-1])[same]
        lags.update(np.unique(apart[(apart > k // 2) & (apart <= min(k, longest))]).tolist())
        if k >= longest:
            break
        left, right = grams[:-k], grams[k:]
        grams = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        k *= 2
    return sorted(lags)


def find_runs(words: np.ndarray, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers
    (from 0, no gaps), by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for a, b in _segments(words, rules):
        part = words[a:b]
        for lag in _lags(part, (b - a) // rules.repeats):
            same = np.zeros(b - a - lag + 2, np.int8)
            same[1:-1] = part[lag:] == part[:-lag]
            turns = np.flatnonzero(np.diff(same))
            begin, matched = turns[::2], turns[1::2] - turns[::2]
            for k in np.flatnonzero(matched + lag >= max(rules.min_words, rules.repeats * lag)):
                # Lags rise: a stretch seen before has a smaller period.
                found.setdefault((a + int(begin[k]), int(matched[k]) + lag), lag)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def _entry(run: tuple[int, int, int] | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run, strict=True))


def _numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _scan(rules: RunRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, best, collapsed = [], [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                found = find_runs(_numbered(words), rules) if len(words) >= rules.min_words else []
                if found:
                    kept = np.ones(len(words), bool)
                    for start, length, period in found:
                        kept[start + period : start + length] = False
                    words_kept = [words[i] for i in np.flatnonzero(kept)]
                else:
                    words_kept = words
                counts.append(len(words))
                runs.append([_entry(r) for r in found])
                best.append(_entry(_most_repeated(found)))
                collapsed.append(b" ".join(words_kept).decode())
            made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_ARROW_RUN)), pa.array(best, _ARROW_RUN), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "n_words", "runs", "most_repeated", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """row, n_words, runs, most_repeated, collapsed of rows with a ``text``.

    ``row`` is the given row as one column, without its text, so its columns
    may have any names; ``runs`` lists start, length and period of every run by
    start, then period; ``most_repeated`` is the one with the greatest
    length / period (ties: smallest start, then period), null where there is
    none; ``collapsed`` joins, by one space, the words that no run repeats: all
    but those which some run holds after its first period.

    Words are what ASCII white space separates.  A null or empty text has no
    words, no runs and an empty collapsed text; repeated rows give a row each;
    no rows give no rows.  A text is one task's work: memory follows the
    longest text, time its length times the lags at which it repeats itself.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN))
    schema = schema.add("most_repeated", _RUN).add("collapsed", T.StringType())
    with batch_rows(docs.sparkSession, 1024):
        return rows.mapInArrow(_scan(rules), schema)
