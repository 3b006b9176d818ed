"""Cached lookups as a batch, over runs, and as a stream that is restarted."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loomarc.operators import lookups
from loomarc.streaming.lookups import STATE_STORE, lookup_stream

HOUR = 3600


def requests(seed, n=120):
    rng, rows = random.Random(seed), []
    for k in range(n):
        outcome = rng.choices(("found", "empty", "unavailable"), (1, 6, 2))[0]
        rows.append((rng.choice("aaab"), k, rng.randrange(40 * HOUR), outcome, f"x{k}" if outcome == "found" else None))
    return rows


def by_hand(rows):
    """One request after another, by the rules as told."""
    state, out = {}, []
    for key, name, at, outcome, answer in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        checked, known, misses = state.get(key, (None, None, 0))
        wait = 24 * HOUR if known else min(1800 * 2 ** (misses - 1), 7 * 24 * HOUR) if misses else 0
        asked = checked is None or at >= checked + wait
        if asked and outcome == "found":
            state[key] = (at, answer, 0)
        elif asked and outcome == "empty":
            state[key] = (at, None, misses + 1)
        _, known, misses = state.get(key, (None, None, 0))
        out.append((key, name, at, asked, known, misses))
    return sorted(out)


SCHEMA = "key string, name long, at long, outcome string, answer string"


def test_replayed(spark):
    rows = requests(1)
    frame = spark.createDataFrame([*rows, (None, 1, 1, "found", "x")], SCHEMA)
    assert sorted(map(tuple, lookups.replayed(frame).collect())) == by_hand(rows)
    assert lookups.replayed(frame.limit(0)).count() == 0


def test_runs(spark):
    """Jobs of a run, and the cache after it, give what requests one by one do."""
    now = dt.datetime(2024, 5, 1)
    cache = spark.createDataFrame([], "key string, checked_at timestamp, answer string, misses long")
    stamp = lambda hours: F.lit(now + dt.timedelta(hours=hours)).cast("timestamp")
    wanted = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), ("c", 9)], "key string, place int")
    due = lambda hours, most=9: [tuple(r) for r in lookups.jobs(wanted, cache, ["key"], [F.col("place")], stamp(hours), most).collect()]
    assert due(0) == [("a", 0), ("b", 0), ("c", 0)] and due(0, 2) == [("a", 0), ("b", 0)]
    told = spark.createDataFrame([("a", "found", "x"), ("b", "empty", None), ("c", "unavailable", None)], "key string, outcome string, answer string")
    cache = lookups.after(cache, told, ["key"], stamp(0))
    assert due(0.4) == [("c", 0)] and due(0.5) == [("b", 1), ("c", 0)] and due(24) == [("a", 0), ("b", 1), ("c", 0)]
    cache = lookups.after(cache, spark.createDataFrame([("b", "empty", None), ("a", "empty", None)], told.schema), ["key"], stamp(24))
    assert {r.key: (r.answer, r.misses) for r in cache.collect()} == {"a": (None, 1), "b": (None, 2)}
    tries = spark.createDataFrame([(None, None), (1, 23), (1, 24), (6, 30), (7, 99)], "n int, h int")
    ago = stamp(0) - F.make_interval(hours=F.col("h"))
    assert [r[0] for r in tries.select(lookups.retry_due(F.col("n"), ago, stamp(0))).collect()] == [True, False, True, True, False]


def test_stream_that_is_restarted(spark, tmp_path):
    """Micro-batches in order of time, the query stopped and started again
    between them, give the table of the batch form; timers tell what is due."""
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        rows = sorted(requests(2, 60), key=lambda r: (r[2], r[1]))
        got = []
        for run in range(3):
            spark.createDataFrame(rows[20 * run : 20 * run + 20], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = lookup_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), late="2 days")
            writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
            got.append(spark.read.parquet(str(tmp_path / "out")).count())
        out = spark.read.parquet(str(tmp_path / "out"))
        served = out.where("kind = 'request'").drop("kind").collect()
        assert sorted(map(tuple, served)) == by_hand(rows) and got[0] < got[1] < got[2]
    finally:
        spark.conf.set(STATE_STORE[0], before)
