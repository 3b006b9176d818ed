"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window (``window`` consecutive item words, or the whole of a
shorter item) is the set of its word shingles, each at a fixed place.
Shingles are ordered by their frequency over all documents, rarest first; as
a window must be contained whole, its prefix is one token, its rarest
shingle.  One scan lists where shingles of the benchmark stand in each
document; prefix tokens are joined with those places, windows that would
reach over either end of a text are dropped by length and position, and the
rest are verified: every shingle of the window must stand at its own place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext, worker
from .common import batch_rows, staged, without


@dataclass(frozen=True)
class Decontamination:
    """window: words that count as contamination; shingle: words per token;
    share: hit words, as 1 / share of all words, from which a document is
    contaminated; broadcast_shingles: the most distinct shingles (8 bytes
    each) that are sent to every executor.  A larger benchmark is joined by a
    shuffle on the shingle, with the same result."""

    window: int = 13
    shingle: int = 5
    share: int = 20
    broadcast_shingles: int = 1_000_000


def _item_windows(rule: Decontamination):
    """Rows of the windows of items: one for each shingle of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for at, to, raw, offs in bytetext.slices(batch.column("text")):
                w = bytetext.words(raw, offs, bytetext.ALNUM)
                for i in range(to - at):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    if not len(h):
                        continue
                    k = min(rule.shingle, len(h))
                    size = min(rule.window, len(h))
                    grams = bytetext.ngrams(h, k)
                    per, n = size - k + 1, len(h) - size + 1
                    at_ = np.arange(n)[:, None] + np.arange(per)
                    sig = grams[at_].view(np.int64)
                    # A window's id: equal windows of one item are one.
                    own = bytetext.mix((grams[at_] * bytetext.mix(np.arange(1, per + 1, dtype=np.uint64))).sum(1) + np.uint64(size))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[at + i]] * (n * per), pa.string()),
                            pa.array(np.repeat(own.view(np.int64), per)),
                            pa.array(np.full(n * per, size, np.int32)),
                            pa.array(np.full(n * per, k, np.int32)),
                            pa.array(np.tile(np.arange(per, dtype=np.int32), n)),
                            pa.array(sig.ravel()),
                        ],
                        ["item_id", "window_id", "length", "words", "j", "sig"],
                    )

    return run


_OCCURRENCES = "key long, doc_id long, n_words long, places array<int>, sigs array<long>"


def _occurrences(lengths: list[int], held):
    """Where shingles of the benchmark stand in each document.

    held: a broadcast of the sorted distinct shingles, or None to list all
    shingles of every document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(64 - 22)
        if held:
            known = held.value
            gate = np.zeros(1 << 22, bool)
            gate[(known >> bits).astype(np.int64)] = True
        for batch in batches:
            for at, to, raw, offs in bytetext.slices(batch.column("text")):
                w = bytetext.words(raw, offs, bytetext.ALNUM)
                places, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for k in lengths:
                    grams = bytetext.ngrams(w.hash, k)
                    place = np.flatnonzero(gate[(grams >> bits).astype(np.int64)]) if held else np.arange(len(grams))
                    if held and len(place):
                        nearest = known[np.minimum(np.searchsorted(known, grams[place]), len(known) - 1)]
                        place = place[nearest == grams[place]]
                    ends = w.first[np.searchsorted(w.first, place, "right")]
                    place = place[place + k <= ends]
                    places.append(place)
                    sigs.append(grams[place])
                place, sig = np.concatenate(places), np.concatenate(sigs)
                order = np.argsort(place, kind="stable")
                place, sig = place[order], sig[order]
                cut = np.searchsorted(place, w.first).astype(np.int32)
                inside = place - w.first[np.searchsorted(w.first, place, "right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(at, to - at),
                        batch.column("doc_id").slice(at, to - at),
                        pa.array(np.diff(w.first)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(inside.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(sig.view(np.int64))),
                    ],
                    ["key", "doc_id", "n_words", "places", "sigs"],
                )

    return run


def _exploded(found: DataFrame) -> DataFrame:
    """One row for each place; a repeated row of the documents counts once."""
    return (
        found.where("size(places) > 0")
        .dropDuplicates(["key"])
        .select("key", "n_words", F.explode(F.arrays_zip("places", "sigs")).alias("o"))
        .select("key", "n_words", F.col("o.places").alias("place"), F.col("o.sigs").alias("sig"))
    )


def contamination(docs: DataFrame, items: DataFrame, rule: Decontamination = Decontamination()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs: doc_id, text; items: item_id, text.  Null and empty texts have no
    words and are never contaminated; items without words or id are skipped;
    repeated rows each get their row; items with one id count as one item;
    other columns are ignored; with no items nothing is hit.
    """
    spark = docs.sparkSession
    windows = staged(
        items.where("item_id is not null")
        .select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_item_windows(rule), "item_id string, window_id long, length int, words int, j int, sig long")
        .distinct(),
        "windows",
    )
    lengths = sorted(r[0] for r in windows.select("words").distinct().collect())
    texts = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    distinct = windows.select("sig").distinct()
    if distinct.limit(rule.broadcast_shingles + 1).count() <= rule.broadcast_shingles:
        known = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
        held = spark.sparkContext.broadcast(known)
        with batch_rows(spark, 1024):
            found = staged(texts.mapInArrow(worker.releasing(_occurrences(lengths, held)), _OCCURRENCES), "occurrences")
        places = _exploded(found)
    else:
        every = _exploded(texts.mapInArrow(worker.releasing(_occurrences(lengths, None)), _OCCURRENCES))
        places = staged(every.join(distinct, "sig", "left_semi").select("key", "n_words", "place", "sig"), "occurrences")
        found = texts.mapInArrow(worker.releasing(_occurrences([], None)), _OCCURRENCES)

    # The order: frequency over all documents; a window with a shingle that
    # stands nowhere cannot occur.
    frequency = places.groupBy("sig").agg(F.count("*").alias("n"))
    grams = windows.select("window_id", "length", "j", "sig").distinct()
    prefix = (
        grams.join(frequency, "sig", "left")
        .groupBy("window_id", "length")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "sig")).alias("rarest"), F.count("*").alias("need"))
        .where("rarest.n > 0")
        .select("window_id", "length", "need", F.col("rarest.j").alias("j"), F.col("rarest.sig").alias("sig"))
    )
    candidates = (
        places.join(prefix, "sig")
        .select("key", "n_words", "window_id", "length", "need", (F.col("place") - F.col("j")).alias("start"))
        .where("start >= 0 and start + length <= n_words")
    )
    verified = (
        candidates.join(grams.select("window_id", "j", "sig"), "window_id")
        .withColumn("place", F.col("start") + F.col("j"))
        .join(places.select("key", "place", "sig"), ["key", "place", "sig"], "left_semi")
        .groupBy("key", "window_id", "start", "length", "need")
        .agg(F.count("*").alias("got"))
        .where("got = need")
        .select("key", "window_id", "start", (F.col("start") + F.col("length")).alias("end"))
    )
    verified = staged(verified, "verified")
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hits = (
        verified.select("key", "start", "end")
        .distinct()
        .withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).cast("long").alias("n_hit"))
    )
    named = (
        verified.select("key", "window_id")
        .distinct()
        .join(windows.select("window_id", "item_id").distinct(), "window_id")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        found.select("key", "doc_id", "n_words")
        .join(hits.join(named, "key"), "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        )
        .withColumn("n_items", F.greatest("n_items", F.lit(0)).cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(rule.share) * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame, rule: Decontamination = Decontamination()) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    Each row is decided by its text alone, whatever its doc_id, so null and
    repeated ids do no harm; null and empty texts stay; columns of any name
    are kept; no rows give no rows.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"), "text")
    bad = contamination(keyed.select(F.col("key").alias("doc_id"), "text"), items, rule).where("contaminated")
    return without(keyed.drop("text"), "key", bad.select("doc_id")).select("row.*")
