"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from loomarc.llm import periodic_runs, queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(w, least=24, repeats=3):
    """All maximal stretches of every period, smallest period first."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(least, repeats * q):
                stretch = w[s : e + q]
                if not any(all(x == y for x, y in zip(stretch, stretch[d:], strict=False)) for d in range(1, q)):
                    found[(s, e + q - s)] = q
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def sequences():
    rng = random.Random(4)
    for letters in (1, 2, 3, 30):
        for n in (0, 1, 23, 24, 25, 90, 240):
            yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(60):  # periods of several kinds, beside and inside one another
        w = []
        for _ in range(rng.randint(1, 5)):
            base = [rng.randrange(rng.choice((2, 4, 60))) for _ in range(rng.randint(1, 20))]
            w += (base * 40)[: rng.randint(len(base), 8 * len(base) + 20)]
            w += [rng.randrange(1000) for _ in range(rng.choice((0, 0, 1, 7)))]
        yield w
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    yield b  # a Fibonacci word


def test_runs_of_sequences():
    some = 0
    for w in sequences():
        ids = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, np.int64)
        want = brute_force(w)
        assert periodic_runs.find_runs(ids) == want
        some += len(want) > 1
    assert some > 10
    for w in list(sequences())[::3]:
        ids = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, np.int64)
        assert periodic_runs.find_runs(ids, periodic_runs.RunRules(6, 4)) == brute_force(w, 6, 4)


def test_long_text_is_quick():
    base = np.arange(50_000)
    runs = periodic_runs.find_runs(np.concatenate([base, base, base, base[:77]]))
    assert runs == [(0, 150_077, 50_000)]
    assert periodic_runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_rows_of_any_kind(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "a b " * 20, None), (5, "é 漢 x y " * 9, "y"), (5, "é 漢 x y " * 9, "y"), (6, "w " * 60_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("runs", F.lit(1)).withColumn("a.b", F.lit(2))
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == len(rows) and set(got[0].row.asDict()) == {"doc_id", "row", "runs", "a.b"}
    for r, text in ((r, t) for r in got for i, t, _ in dict.fromkeys(rows) if i == r.row.doc_id):
        w = SPACED.findall(text or "")
        runs = [(0, len(w), 1)] if r.row.doc_id == 6 else brute_force(w)
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs and r.collapsed == " ".join(kept(w, runs))
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op12(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(0, 150)))) for k in range(150)] + [(200, None), (None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for k, text in rows:
        w = SPACED.findall(text or "")
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_force(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = best[1] * 1000 // best[2] if runs else None
        want.append((k, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept(w, runs)).encode()).hexdigest()))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert planted > 5 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
