"""Answers of providers kept for a time, and retries that wait longer each time.

A key's entry is (checked_at, answer, misses).  An answer is good for a day; an
empty one for half an hour, doubled with each further miss up to a week.  While
an entry is fresh it serves requests; else the provider is asked, and what it
says replaces the entry.  A provider that is unavailable changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates

FOUND_SECONDS = 24 * 3600
MOST_ATTEMPTS, BETWEEN_ATTEMPTS = 7, 24 * 3600
FOUND, EMPTY, UNAVAILABLE = "found", "empty", "unavailable"


def fresh_until(checked_at: Column, answer: Column, misses: Column) -> Column:
    wait = F.when(answer.isNotNull(), F.lit(FOUND_SECONDS)).otherwise(60 * dates.retry_minutes(misses))
    return F.timestamp_seconds(F.unix_seconds(checked_at) + wait)


def jobs(wanted: DataFrame, cache: DataFrame, key: list[str], order: list[Column], now: Column, most: int) -> DataFrame:
    """The ``most`` first keys wanted whose entry is missing or not fresh, with
    the misses so far.  A key that several items want is asked once, at its
    first place in the order."""
    first = wanted.groupBy(*key).agg(F.min(F.struct(*order)).alias("_at"))
    stale = first.join(cache, key, "left").where(~F.coalesce(now < fresh_until(F.col("checked_at"), F.col("answer"), F.col("misses")), F.lit(False)))
    return stale.orderBy("_at", *key).limit(most).select(*key, F.coalesce("misses", F.lit(0)).alias("misses"))


def after(cache: DataFrame, outcomes: DataFrame, key: list[str], now: Column) -> DataFrame:
    """The cache after the outcomes (key, outcome, answer) of a run."""
    told = outcomes.where(F.col("outcome") != UNAVAILABLE).withColumnRenamed("answer", "_answer")
    joined = cache.join(told, key, "full_outer")
    hit, miss = F.col("outcome") == FOUND, F.col("outcome") == EMPTY
    return joined.select(
        *key,
        F.when(F.col("outcome").isNotNull(), now).otherwise(F.col("checked_at")).alias("checked_at"),
        F.when(hit, F.col("_answer")).when(~F.coalesce(miss, F.lit(False)), F.col("answer")).alias("answer"),
        F.when(hit, 0).when(miss, F.coalesce("misses", F.lit(0)) + 1).otherwise(F.col("misses")).cast("long").alias("misses"),
    )


def retry_due(attempts: Column, failed_at: Column, now: Column) -> Column:
    """Whether a failed capture is tried again: never failed, or fewer than
    seven times and the last a day ago or more."""
    waited = F.unix_seconds(now) - F.unix_seconds(failed_at) >= BETWEEN_ATTEMPTS
    return F.coalesce((attempts < MOST_ATTEMPTS) & waited, attempts.isNull() | failed_at.isNull())


@dataclass
class Entry:
    """One key's entry as requests pass, in order of time; seconds as numbers."""

    checked_at: int | None = None
    answer: str | None = None
    misses: int = 0

    def until(self) -> int | None:
        """Second from which the provider is asked again."""
        if self.checked_at is None:
            return None
        wait = FOUND_SECONDS if self.answer is not None else 60 * min(30 << min(self.misses - 1, 31), 10_080) if self.misses else 0
        return self.checked_at + wait

    def request(self, at: int, outcome: str, answer: str | None) -> bool:
        """Serve a request; whether the provider was asked, which would then
        say ``outcome``."""
        until = self.until()
        if until is not None and at < until:
            return False
        if outcome == FOUND:
            self.checked_at, self.answer, self.misses = at, answer, 0
        elif outcome == EMPTY:
            self.checked_at, self.answer, self.misses = at, None, self.misses + 1
        return True


def served(key: T.DataType, name: T.DataType) -> T.StructType:
    fields = [("key", key), ("name", name), ("at", T.LongType()), ("asked", T.BooleanType()), ("answer", T.StringType()), ("misses", T.LongType())]
    return T.StructType([T.StructField(n, kind) for n, kind in fields])


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, entry = None, Entry()
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.key != last:
                last, entry = r.key, Entry()
            asked = entry.request(r.at, r.outcome, r.answer)
            out.append((r.key, r.name, r.at, asked, entry.answer, entry.misses))
        yield pd.DataFrame(out, columns=["key", "name", "at", "asked", "answer", "misses"])


def replayed(requests: DataFrame) -> DataFrame:
    """What every request (key, name, at, outcome, answer) was given: key,
    name, at, asked, answer and the misses after it.

    ``at`` is in whole seconds, ties go by name, and null keys are left out.
    Rows pass sorted by key and time, one entry held at a time, so neither
    keys nor their requests need fit into memory; a key's requests are one
    task's, as each depends on the one before.
    """
    rows = requests.where(F.col("key").isNotNull()).select("key", "name", "at", "outcome", "answer")
    shape = served(rows.schema["key"].dataType, rows.schema["name"].dataType)
    return rows.repartition("key").sortWithinPartitions("key", "at", "name").mapInPandas(_replayed, shape)
