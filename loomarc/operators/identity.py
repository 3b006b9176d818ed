"""Article identity: items that share a key, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(items: DataFrame, name: str, keys: Column) -> DataFrame:
    """(name, root): root is the smallest ``name`` that a chain of shared keys
    reaches, the item's own where it shares none.

    Labels pass from items to keys and back, halved by label of label, until
    none changes; each round is a written table and every aggregate is
    partial before its shuffle, so a key that a third of all items share is
    no task of its own.  Null keys join nothing.
    """
    links = items.select(F.col(name).alias("item"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    shared = links.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low <> high").select("key")
    links = written(links.join(shared, "key"), "identity")
    labels = written(links.select("item", F.col("item").alias("root")).distinct(), "identity")
    while True:
        least = links.join(labels, "item").groupBy("key").agg(F.min("root").alias("root"))
        near = links.join(least, "key").groupBy("item").agg(F.min("root").alias("root"))
        known = labels.select(F.col("item").alias("root"), F.col("root").alias("further"))
        jumped = near.join(known, "root", "left").select("item", F.least("root", "further").alias("root"))
        again = written(jumped, "identity")
        changed = again.join(labels.withColumnRenamed("root", "was"), "item").where("root <> was").limit(1).count()
        labels = again
        if not changed:
            break
    roots = labels.withColumnRenamed("item", name)
    return items.select(name).distinct().join(roots, name, "left").select(name, F.coalesce("root", F.col(name)).alias("root"))
