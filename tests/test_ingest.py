"""Ingest plans against taking one entry after another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomarc.operators import ingest

DAY = dt.datetime(2024, 1, 1)


def one_by_one(entries, seen, existing, evicted, links):
    known, readmitted, out = set(seen), set(), {}
    for name, source, at, link, keys in sorted(entries, key=lambda e: (e[2], e[0])):
        own = [(source, k) for k in keys]
        path = next((existing[k] for k in own if k in existing), None)
        is_known, action = any(k in known for k in own), "add"
        if is_known and path is None and not any(k in readmitted for k in own) and any(k in evicted for k in own):
            is_known, action = False, "readmit"
        if not is_known and link in links:
            out[name] = ("elsewhere", None)
            continue
        if is_known:
            out[name] = ("update", path) if path is not None else ("known", None)
            continue
        if action == "readmit":
            readmitted |= set(own)
        known |= set(own)
        out[name] = (action, None)
    return out


@pytest.mark.parametrize(("seed", "n_keys", "actions"), [(1, 60, {"add", "readmit", "update", "known", "elsewhere"}), (2, 12, {"add", "readmit", "known"})])
def test_plan(spark, seed, n_keys, actions):
    rng = random.Random(seed)
    key = lambda: f"k{rng.randrange(n_keys)}"
    entries = [(k, rng.choice("aab"), DAY + dt.timedelta(days=rng.randrange(9)), f"l{rng.randrange(40)}", [key() for _ in range(rng.randint(1, 3))]) for k in range(70)]
    entries.append((99, "a", DAY, "x", []))
    seen = {(s, f"k{k}") for s in "ab" for k in range(n_keys) if rng.random() < 0.35}
    existing = {k: f"p{n}" for n, k in enumerate(sorted(seen)) if rng.random() < 0.3}
    evicted = {k for k in sorted(seen) if k not in existing and rng.random() < 0.5}
    links = {"l1", "l2"}
    frame = spark.createDataFrame(entries, "name long, source string, at timestamp, link string, keys array<string>").repartition(3)
    pairs = lambda some: spark.createDataFrame(sorted(some), "source string, key string")
    paths = spark.createDataFrame([(*k, p) for k, p in existing.items()], "source string, key string, path string")
    made = ingest.plan(frame, pairs(seen), paths, pairs(evicted), spark.createDataFrame([(x,) for x in links], "link string"), "name", "source", "at")
    got = {r.name: (r.action, r.path) for r in made.collect()}
    want = one_by_one(entries, seen, existing, evicted, links)
    assert got == want and {a for a, _ in want.values()} == actions


def test_limits(spark):
    rows = [(k, "s", DAY + dt.timedelta(days=k)) for k in range(5)] + [(9, "s", None), (7, "t", DAY)]
    frame = spark.createDataFrame(rows, "name long, source string, at timestamp")
    now, cutoff = F.lit(DAY + dt.timedelta(days=30)), F.lit(DAY + dt.timedelta(days=1))
    kept = ingest.limited(frame, "source", "at", now, cutoff, F.when(F.col("source") == "s", 3), "name")
    assert sorted(r.name for r in kept.collect()) == [3, 4, 9]
    assert ingest.limited(frame, "source", "at", now, F.lit(None).cast("timestamp"), F.lit(0), "name").count() == 7
