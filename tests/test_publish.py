"""Publishing by content, and completion of labels."""

import random

from pyspark.sql import functions as F

from loomarc.operators import completion
from loomarc.sinks import publish


def test_only_what_changed_is_written(spark, tmp_path):
    path = str(tmp_path / "site")
    items = spark.createDataFrame([(k, f"text {k}", None if k % 5 else 1.5) for k in range(200)], "id long, text string, score double")
    version, written = publish.publish(items, "id", path, 8)
    assert written == 8 and publish.published(spark, path).count() == 200
    assert publish.publish(items.orderBy(F.desc("id")).repartition(7).select("score", "text", "id"), "id", path, 8) == (version, 0)
    changed = items.withColumn("text", F.when(F.col("id") == 3, "new").otherwise(F.col("text")))
    second, written = publish.publish(changed, "id", path, 8)
    assert written == 1 and second != version
    assert publish.published(spark, path).where("text = 'new'").count() == 1 and publish.published(spark, path).count() == 200
    assert publish.published(spark, path, 1).where("text = 'new'").count() == 0
    assert publish.stale(spark, path).count() == 0
    assert publish.publish(items, "id", path, 8) == (version, 0)  # all its buckets are stored
    assert publish.published(spark, path).where("text = 'new'").count() == 0
    assert publish.publish(items.where("id < 100"), "id", path, 8)[1] == 8
    assert publish.published(spark, path).count() == 100 and publish.stale(spark, path).count() == 1


def test_receipts(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, body string")
    receipts = spark.createDataFrame([("a", "x", "v2"), ("b", "old", "v2"), ("c", "z", "v1")], "id string, digest string, parser string")
    assert sorted(r.id for r in publish.unparsed(items, receipts, "id", F.col("body"), "v2").collect()) == ["b", "c"]


def test_completions(spark):
    rng = random.Random(2)
    rows = [("k", f"v{k}", "".join(rng.choice("abÄ c") for _ in range(rng.randint(0, 6))), k % 4) for k in range(60)] + [("other", "v1", "aa", 1)]
    facets = spark.createDataFrame(rows, "kind string, value string, label string, count long")
    index = completion.gram_index(facets).cache()
    for fragment in ("", "a", "Ab", "abc", "ä c", "v1", "bab v2", "zzz"):
        want = sorted(v for kind, v, label, _ in rows if kind == "k" and fragment.lower() in f"{label} {v}".lower())
        assert sorted(r.value for r in completion.completions(facets, index, "k", fragment).collect()) == want
    held = completion.holding(index, "k", "abab").count()
    assert held < 60
    days = spark.createDataFrame([("2024-01-02", 1), ("2024-02-01", 2)], "value string, count long")
    assert [r.value for r in completion.day_completions(days, "2024-02").collect()] == ["2024-02-01"]


def test_resolved(spark):
    facets = spark.createDataFrame([("s", "a", "One"), ("s", "b", "Two"), ("s", "c", "two"), ("s", "One", "x"), ("t", "d", "Two")], "kind string, value string, label string")
    named = spark.createDataFrame([("s", "a"), ("s", "ONE"), ("s", "One"), ("s", "two"), ("t", "TWO"), ("t", "a"), ("s", "X")], "kind string, name string")
    got = {(r.kind, r.name): (r.value, r.problem) for r in completion.resolved(named, facets).collect()}
    assert got == {("s", "a"): ("a", None), ("s", "ONE"): ("a", None), ("s", "One"): ("One", None), ("s", "two"): (None, "ambiguous"), ("t", "TWO"): ("d", None), ("t", "a"): (None, "unknown"), ("s", "X"): ("One", None)}


def test_grams_of_a_value_with_many_labels(spark):
    """Each gram of a value is told once, and no step tells them apart after
    they are made: that would hold the grams of all values in one task."""
    facets = spark.createDataFrame([("k", "v", f"ab{k % 3}", 1) for k in range(30)] + [("k", None, None, 0)], "kind string, value string, label string, count long")
    index = completion.gram_index(facets)
    assert sorted(r.gram for r in index.collect()) == sorted({g for t in ("ab0 v", "ab1 v", "ab2 v") for n in (1, 2, 3) for k in range(len(t) - n + 1) for g in [t[k : k + n]]})
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1
