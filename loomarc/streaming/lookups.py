"""Cached lookups as a stream: the state of :mod:`..operators.lookups` kept by
Spark for every key, with timers that ask again when an entry is no longer
fresh, and a lifetime for keys that nobody wants any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lookups import Entry

#: Provider of states that timers and lifetimes need (a setting of the session).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_ENTRY = T.StructType([T.StructField("checked_at", T.LongType()), T.StructField("answer", T.StringType()), T.StructField("misses", T.LongType())])


class Lookups(StatefulProcessor):
    """Rows of ``kind`` request for every request, as it was served, and of
    ``kind`` due when event time passes the end of an entry's freshness."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _ENTRY, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.entry.get() if self.entry.exists() else None
        entry = Entry(*kept) if kept else Entry()
        before = entry.until()
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "name"]).itertuples(index=False):
            asked = entry.request(int(r.at), r.outcome, r.answer)
            out.append(("request", key[0], r.name, int(r.at), asked, entry.answer, entry.misses))
        self.entry.update((entry.checked_at, entry.answer, entry.misses))
        if entry.until() != before:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(1000 * entry.until())
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        entry = Entry(*self.entry.get())
        yield _frame([("due", key[0], None, expiredTimerInfo.getExpiryTimeInMs() // 1000, False, entry.answer, entry.misses)])

    def close(self) -> None:
        pass


_COLUMNS = ["kind", "key", "name", "at", "asked", "answer", "misses"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"name": "Int64"})


def lookup_stream(requests: DataFrame, late: str = "1 hour", keep_ms: int | None = None) -> DataFrame:
    """The requests (key string, name long, at in seconds, outcome, answer) of
    a stream as served, and the keys due again.

    Rows later than ``late`` behind the newest are dropped, and requests of a
    key that come in one batch are taken by time; ``keep_ms`` lets entries go
    that long after their last change.
    """
    stamped = requests.where("key is not null").withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    shape = "kind string, key string, name long, at long, asked boolean, answer string, misses long"
    return stamped.groupBy("key").transformWithStateInPandas(Lookups(keep_ms), shape, outputMode="Append", timeMode="EventTime")
