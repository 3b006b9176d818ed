"""Groups of consecutive rows that end where a limit counted from the group's
first row is reached: files of so many rows and bytes, paragraphs of so many
seconds.

Where a group ends depends on where it began, so no window finds it.  But each
row can tell where a group that began with it would end, by a search over
running sums or the ordering value.  From the first row of each key, these
jumps lead from cut to cut.  They are followed by doubling: after r rounds the
jumps are 2^r groups long and the first 2^r cuts of every key are known, so a
key with n groups takes log n rounds, all of them joins on row numbers that
have no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scans import nearest, running


@dataclass(frozen=True)
class Limits:
    """Of a group: most rows; the most that sums of whole, positive numbers
    may come to; and the distance of the first ordering value (a long) from
    the group's first that begins another.  A single row is always a group."""

    rows: int | None = None
    sums: dict[str, int] = field(default_factory=dict)
    distance: int | None = None


def _search(rows: DataFrame, order: list[str], probe: Column, at: str, wins: bool, name: str) -> DataFrame:
    """(nth, name): for each row the first row whose ``at`` is above ``probe``
    (or, with ``wins``, also equal to it), within the values of ``order``."""
    keep = [c for c in order if c != at]
    own = rows.select(*keep, F.col(at).alias("_at"), F.lit(1 if wins else 0).alias("_kind"), "nth")
    probes = rows.select(*keep, probe.alias("_at"), F.lit(0 if wins else 1).alias("_kind"), "nth")
    found = nearest(own.union(probes), [*keep, "_at", "_kind", "nth"], F.when(F.col("_kind") == (1 if wins else 0), F.col("nth")), name, after=True)
    return found.where(F.col("_kind") == (0 if wins else 1)).select("nth", name)


def cut(items: DataFrame, key: list[str], order: list[str], limits: Limits) -> DataFrame:
    """items with ``group``, from 0 within each key in the order.

    Key and order together tell rows apart, and hold no nulls; where a
    distance is limited, it is one of the first column of the order.
    """
    if not (limits.rows or limits.sums or limits.distance):
        raise ValueError("groups need a limit")
    sums = {f"_sum_{c}": F.col(c) for c in limits.sums}
    place = [*key, *order]
    rows = running(items, place, {"nth": F.lit(1), **sums}).withColumn("nth", F.col("nth") - 1)
    rows = written(rows, "cuts")
    ends = [rows.select("nth", (F.col("nth") + limits.rows).alias("to"))] if limits.rows else []
    for c, most in limits.sums.items():
        ends.append(_search(rows, [f"_sum_{c}"], F.col(f"_sum_{c}") - F.col(c) + most, f"_sum_{c}", False, "to"))
    if limits.distance:
        ends.append(_search(rows, [*key, order[0]], F.col(order[0]) + limits.distance, order[0], True, "to"))
    least = reduce(DataFrame.union, ends).groupBy("nth").agg(F.min("to").alias("to"))
    least = least.where("to is not null").select("nth", F.greatest(F.col("to"), F.col("nth") + 1).alias("to"))
    if key:  # a jump ends with its key
        owns, its = rows.select("nth", F.struct(*key).alias("_key")), rows.select(F.col("nth").alias("to"), F.struct(*key).alias("_its"))
        least = least.join(owns, "nth").join(its, "to").where(F.col("_key") == F.col("_its")).select("nth", "to")
        marks = rows.groupBy(*key).agg(F.min("nth").alias("nth")).select("nth")
    else:
        marks = rows.agg(F.min("nth").alias("nth")).where("nth is not null")
    jumps, marks = written(least, "jumps"), written(marks, "marks")
    while True:
        known = marks.count()
        marks = written(marks.union(marks.join(jumps, "nth").select("to")).distinct(), "marks")
        if marks.count() == known:
            break
        jumps = written(jumps.join(jumps.toDF("to", "further"), "to").select("nth", F.col("further").alias("to")), "jumps")
    marked = rows.drop(*sums).join(marks.withColumn("_mark", F.lit(1)), "nth", "left")
    # Every row counts the marks up to it; a key begins with one.
    counted = running(marked, ["nth"], {"group": F.col("_mark")})
    if key:
        firsts = written(counted, "cuts").groupBy(*key).agg(F.min("group").alias("_first"))
        counted = counted.join(firsts, key).withColumn("group", F.col("group") - F.col("_first")).drop("_first")
    else:
        counted = counted.withColumn("group", F.col("group") - 1)
    return counted.drop("nth", "_mark")
