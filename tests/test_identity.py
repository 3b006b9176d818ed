"""Identity, candidates and names of items against brute force."""

import datetime
import hashlib
import random

from pyspark.sql import functions as F

from loomarc.functions import paths
from loomarc.operators import identity, related


def test_identity_reaches_through_chains(spark):
    rows = [(k, [f"k{k}", f"k{k + 1}"]) for k in range(9, 0, -1)] + [(20, ["x", None]), (21, ["x", "x"]), (30, []), (31, None), (32, ["own"])]
    items = spark.createDataFrame(rows, "id long, keys array<string>")
    got = {r[0]: r[1] for r in identity.components(items, "id", F.col("keys")).collect()}
    assert got == {**dict.fromkeys(range(1, 10), 1), 20: 20, 21: 20, 30: 30, 31: 31, 32: 32}
    assert identity.components(items.limit(0), "id", F.col("keys")).count() == 0


def test_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [f"label:{rng.randrange(4)}", f"category:{rng.randrange(3)}", *[f"title:{rng.randrange(9)}" for _ in range(2)], f"title:own{k}"]) for k in range(60)]
    rows += [(100, ["category:9", "title:1"]), (101, ["category:9"]), (102, ["title:alone"])]
    items = spark.createDataFrame(rows, "id long, features array<string>")
    weighted = related.weighted_features(items, "id", F.col("features"))
    weight = {r["feature"]: r["weight"] for r in weighted.select("feature", "weight").distinct().collect()}
    wanted = set()
    for a, fa in rows:
        scored = [(-sum(weight[f] for f in set(fa) & set(fb)), b) for b, fb in rows if b != a and set(fa) & set(fb)]
        wanted |= {(a, b, -s, n + 1) for n, (s, b) in enumerate(sorted(scored)[:3])}
    assert {tuple(r) for r in related.candidates(weighted, "id", 3).collect()} == wanted


def test_names(spark):
    day = datetime.datetime(2024, 3, 5)
    titles = ["Hello, World!", "", "CON", "a" * 80, "word " * 30, None]
    rows = [(k, day, t) for k, t in enumerate(titles)] + [(k, day, "Same") for k in (10, 11, 12)]
    items = spark.createDataFrame(rows, "id long, day timestamp_ntz, title string").withColumn("folder", paths.item_folder(F.lit("s"), F.col("day")))
    named = paths.unique_stems(items.withColumn("stem", paths.file_stem(F.col("day"), F.col("title"))), "folder", "stem", "id", [F.asc("id")])
    got = {r["id"]: r["name"] for r in named.collect()}
    tag = lambda k: hashlib.sha1(str(k).encode()).hexdigest()[:8]
    assert got[0] == "2024-03-05-hello-world" and got[1] == "2024-03-05-item" and got[2] == f"2024-03-05-item-{tag(2)}"
    assert got[3] == "2024-03-05-" + "a" * 60 and got[4] == "2024-03-05-" + "-".join(["word"] * 12)
    assert got[10] == "2024-03-05-same" and got[11] == f"2024-03-05-same-{tag(11)}"
    assert named.first()["folder"] == "items/s/2024/03" and named.count() == len(rows)
