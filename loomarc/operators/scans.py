"""Running sums and nearest rows in one order over all rows.

Rows are dealt by range, and every task scans its own range, so a key that most
rows share is many tasks; only a row for each range is looked at in one place.  The dealt rows are written first, as
the bounds of ranges are drawn from a sample and must not be drawn twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def dealt(items: DataFrame, order: list[str | Column]) -> DataFrame:
    """items with ``_part``, the number of their range in the order."""
    return written(items.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")


def _carried(ends: DataFrame, keys: list[str], found: dict[str, Column]) -> DataFrame:
    """What ranges carry to others of their key, from a row for each range and
    key.  Only keys of several ranges carry anything, and a range has two of
    those at most: its first key and its last."""
    here = Window.partitionBy(*keys)
    ends = ends.withColumn("_n", F.count("*").over(here)).where("_n > 1").drop("_n")
    return F.broadcast(ends.select("_part", *keys, *[value.alias(f"_{name}") for name, value in found.items()]))


def running(items: DataFrame, order: list[str | Column], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """items with the running sums of whole numbers, each row's own included,
    within each of the ``keys`` where there are any.

    Keys and order must tell rows apart; nulls count as nothing.
    """
    keys = keys or []
    values = {name: F.coalesce(value, F.lit(0)).cast("long") for name, value in sums.items()}
    rows = dealt(items.withColumns(values), [*keys, *order])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part", *keys).agg(*[F.sum(name).alias(name) for name in sums])
    bases = _carried(ends, keys, {name: F.sum(name).over(before) for name in sums})
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({name: F.sum(name).over(here) for name in sums})
    found = _joined(found, bases, keys).withColumns({name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in sums})
    return found.drop("_part", *[f"_{name}" for name in sums])


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their range and key are carried; keys may be null."""
    named = carried.select(F.col("_part").alias("_its_part"), *[F.col(k).alias(f"_its_{n}") for n, k in enumerate(keys)], *[c for c in carried.columns if c != "_part" and c not in keys])
    same = F.col("_part") == F.col("_its_part")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_its_{n}"))
    return rows.join(F.broadcast(named), same, "left").drop("_its_part", *[f"_its_{n}" for n in range(len(keys))])


def nearest(items: DataFrame, order: list[str], value: Column, name: str, after: bool, keys: list[str] | None = None) -> DataFrame:
    """items with ``name``: the first value that is not null at or after each
    row, or the last one at or before it, within its keys."""
    keys = keys or []
    rows = dealt(items.withColumn(name, value), [*keys, *order])
    # Looking ahead is looking back in the reverse order: a frame that grows costs a row each.
    local = Window.partitionBy("_part", *keys).orderBy(*[F.desc(c) if after else F.asc(c) for c in order])
    last = lambda start, end: F.last(name, ignorenulls=True).over(local.rowsBetween(start, end))
    every = rows.withColumn(name, last(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = every.groupBy("_part", *keys).agg(F.first(name, ignorenulls=True).alias(name))
    others = Window.partitionBy(*keys).orderBy(F.desc("_part") if after else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = _carried(ends, keys, {name: F.last(name, ignorenulls=True).over(others)})
    found = _joined(rows.withColumn(name, last(Window.unboundedPreceding, 0)), ends, keys)
    return found.withColumn(name, F.coalesce(name, f"_{name}")).drop("_part", f"_{name}")
