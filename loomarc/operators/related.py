"""Scored recommendations through an inverted index of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def feature_weight(feature: Column, documents: Column, frequency: Column) -> Column:
    """label 100, category 40, a title term 8 and up to 48 for rarity."""
    rarity = F.least(F.lit(48), F.floor(documents * 20 / frequency)).cast("long")
    return F.when(feature.startswith("label:"), 100).when(feature.startswith("category:"), 40).otherwise(8 + rarity).cast("long")


def weighted_features(items: DataFrame, name: str, features: Column) -> DataFrame:
    """(name, feature, weight): weights from the frequency over all items."""
    each = items.select(name, F.explode(F.array_distinct(features)).alias("feature"))
    documents = items.agg(F.count("*").alias("documents"))  # one row
    frequency = each.groupBy("feature").agg(F.count("*").alias("frequency"))
    weights = frequency.crossJoin(F.broadcast(documents)).select(
        "feature", "frequency", feature_weight(F.col("feature"), F.col("documents"), F.col("frequency")).alias("weight")
    )
    return each.join(weights, "feature")


def candidates(features: DataFrame, name: str, top: int) -> DataFrame:
    """The ``top`` best (name, candidate, score) of each item by shared weight,
    ties by candidate.

    Items with the same features are one set, and sets, not items, meet at
    features.  The ``top + 1`` best sets of a set, with their ``top + 1``
    first items each, hold the best items of all its members: whatever comes
    after has as many items before it, one of which may be the item itself.
    A feature of one item alone meets nothing.
    """
    shared = written(features.where("frequency > 1").select(F.col(name).alias("item"), "feature", "weight"), "related")
    items = shared.groupBy("item").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    # A set is named by its first item.
    sets = written(items.groupBy("features").agg(F.min("item").alias("set")), "related")
    items = written(items.join(sets, "features").select("item", "set"), "related")
    heads = items.withColumn("nth", F.row_number().over(Window.partitionBy("set").orderBy("item"))).where(F.col("nth") <= top + 1)
    weights = shared.groupBy("feature").agg(F.first("weight").alias("weight"))
    each = sets.select("set", F.explode("features").alias("feature")).join(weights, "feature")
    each = written(each, "related")
    right = each.select(F.col("set").alias("other"), "feature")
    own = each.groupBy("set").agg(F.max(F.struct("weight", "feature")).alias("heavy"), F.sum("weight").alias("whole"))
    best = Window.partitionBy("set").orderBy(F.desc("score"), "other")
    # Sets that share a set's heaviest feature come first; one without it can
    # weigh no more than the rest.  Only where that could win do all meet.
    first = own.select("set", F.col("heavy.feature").alias("feature")).join(right, "feature").select("set", "other")
    members = each.groupBy("set").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("mine"))
    names = sets.select(F.col("set").alias("other"), F.col("features").alias("its"))
    shared_weight = F.aggregate("its", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(F.try_element_at("mine", f), F.lit(0)))
    scored = first.join(members, "set").join(names, "other").select("set", "other", shared_weight.alias("score"))
    scored = written(scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top + 1), "related")
    least = scored.groupBy("set").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    closed = own.join(least, "set").where((F.col("n") == top + 1) & (F.col("least") > F.col("whole") - F.col("heavy.weight"))).select("set")
    rest = each.join(closed, "set", "left_anti").join(right, "feature").groupBy("set", "other").agg(F.sum("weight").alias("score"))
    rest = rest.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top + 1)
    near = scored.join(closed, "set", "left_semi").unionByName(rest)
    pool = near.drop("nth").join(heads.select(F.col("set").alias("other"), F.col("item").alias("candidate")), "other")
    in_pool = Window.partitionBy("set").orderBy(F.desc("score"), "candidate")
    pool = pool.withColumn("nth", F.row_number().over(in_pool)).where(F.col("nth") <= top + 1).select("set", "candidate", "score")
    met = items.join(pool, "set").where("item <> candidate")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "candidate")))
    return ranked.where(F.col("rank") <= top).select(F.col("item").alias(name), "candidate", "score", "rank")
