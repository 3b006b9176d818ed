"""State that runs carry on: seen keys, statuses, evictions, reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(items: DataFrame, keys: Column, seen: DataFrame, name: str) -> DataFrame:
    """Items none of whose keys is in ``seen`` (key)."""
    known = items.select(name, F.explode(keys).alias("key")).join(seen.select("key"), "key", "left_semi").select(name).distinct()
    return items.join(known, name, "left_anti")


def reserved(items: DataFrame, link: str, order: list[Column]) -> DataFrame:
    """items with ``owns``: whether the row is the first to claim its link."""
    return items.withColumn("owns", F.row_number().over(Window.partitionBy(link).orderBy(*order)) == 1)


def status(previous: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """(source, message, since) after outcomes (source, error).

    An error keeps the time and message it began with, success clears it, and
    a source without an outcome stays as it was.
    """
    joined = previous.join(outcomes, "source", "full_outer").withColumn("_tried", F.col("error").isNotNull())
    failed = F.col("error") != ""
    return joined.where(F.when(F.col("_tried"), failed).otherwise(F.col("message").isNotNull())).select(
        "source", F.coalesce("message", "error").alias("message"), F.coalesce("since", now).alias("since")
    )


def error_runs(events: DataFrame, source: str, order: list[Column], failed: Column, at: str) -> DataFrame:
    """(source, since) of sources whose last events are failures: the start of
    the present run."""
    window = Window.partitionBy(source).orderBy(*order)
    runs = events.withColumn("_ok", F.sum(F.when(failed, 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("_ok").over(Window.partitionBy(source))
    return runs.withColumn("_last", last).where(failed & (F.col("_ok") == F.col("_last"))).groupBy(source).agg(F.min(at).alias("since"), F.count("*").alias("failures"))


def readmitted(evictions: DataFrame, policy: DataFrame) -> DataFrame:
    """(source, key, first_seen): evicted keys whose source's policy changed."""
    changed = evictions.join(policy.withColumnRenamed("policy", "_now"), "source").where(~F.col("policy").eqNullSafe(F.col("_now")))
    return changed.select("source", F.explode("keys").alias("key"), "first_seen").groupBy("source", "key").agg(F.min("first_seen").alias("first_seen"))


def trimmed(files: DataFrame, size: str, used: str, path: str, limit: int, slot: str = "hour") -> DataFrame:
    """The files to evict, least recently used first, until the rest fits.

    A running total over all files would be one task's work: totals of slots
    of time are summed up first, then the files within each slot.
    """
    at = F.coalesce(F.col(used), F.lit(0).cast("timestamp").cast(files.schema[used].dataType))
    slotted = files.withColumn("_slot", F.date_trunc(slot, at)).withColumn("_at", at)
    slots = slotted.groupBy("_slot").agg(F.sum(size).alias("_slot_size"))
    earlier = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    starts = slots.select("_slot", F.coalesce(F.sum("_slot_size").over(earlier), F.lit(0)).alias("_start"))
    total = slots.agg(F.sum("_slot_size").alias("_total"))
    within = Window.partitionBy("_slot").orderBy("_at", path).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum(size).over(within), F.lit(0))
    placed = slotted.join(starts.crossJoin(total), "_slot")  # the total is one row
    return placed.withColumn("_before", before).where(F.col("_total") - F.col("_before") > limit).select(*files.columns)


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys that each side has only once."""
    once = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rows.columns if c not in keys)).where("_n = 1").drop("_n")
    return once(left).join(once(right), keys)


def shared_values(items: DataFrame, name: str, group: Column, values: Column, least: int = 3) -> DataFrame:
    """(group, value, items) of values that ``least`` items of a group have."""
    each = items.select(name, group.alias("group"), F.explode(F.array_distinct(values)).alias("value"))
    return each.groupBy("group", "value").agg(F.count("*").alias("items")).where(F.col("items") >= least)
