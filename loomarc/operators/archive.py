"""Canonical selection, retention, windows, paging, taxonomy and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running


def canonical(items: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    alone = F.col(key).isNull() | (F.col(key) == "")
    return items.where(alone).unionByName(items.where(~alone).withColumn("_nth", rank).where("_nth = 1").drop("_nth"))


def redirects(items: DataFrame, key: str, name: str, order: list[Column]) -> DataFrame:
    """(loser, winner) names of rows that share a key."""
    first = F.first(name).over(Window.partitionBy(key).orderBy(*order))
    return items.where(F.col(key).isNotNull()).withColumn("winner", first).where(F.col(name) != F.col("winner")).select(F.col(name).alias("loser"), "winner")


def retention(items: DataFrame, source: str, created: str, path: str, size: str, cutoff: Column, most: Column, most_bytes: Column) -> DataFrame:
    """items with ``reason``: null for kept rows, else age, count or bytes.

    Per source, newest first and by path: rows before the cutoff go; of the
    rest those beyond the count; of the rest the oldest until the bytes fit.
    Zero or null switches a limit off.
    """
    old = F.coalesce(F.col(created) < cutoff, F.lit(False))
    ranked = running(items.withColumn("_old", old), [F.desc(created), F.asc(path)], {"_nth": F.lit(1), "_bytes": F.col(size)}, [source, "_old"])
    over = F.coalesce((most > 0) & (F.col("_nth") > most), F.lit(False))
    heavy = F.coalesce((most_bytes > 0) & (F.col("_bytes") > most_bytes), F.lit(False))
    reason = F.when(F.col("_old"), "age").when(over, "count").when(heavy, "bytes")
    return ranked.withColumn("reason", reason).drop("_old", "_nth", "_bytes")


def paged(items: DataFrame, order: list[Column], per_page: int, within: str) -> DataFrame:
    """items with ``page`` and ``offset`` in the order of each ``within``."""
    numbered = running(items, order, {"_nth": F.lit(1)}, [within])
    return numbered.withColumns(
        {"page": F.expr(f"(_nth - 1) div {per_page} + 1"), "offset": ((F.col("_nth") - 1) % per_page).cast("long")}
    ).drop("_nth")


def first_page(items: DataFrame, order: list[Column], per_page: int, within: str) -> DataFrame:
    """The first ``per_page`` items of each ``within``; tasks drop the rest
    before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(within).orderBy(*order))
    return items.withColumn("_nth", nth).where(F.col("_nth") <= per_page).drop("_nth")


def taxonomy(items: DataFrame, term: Column, name: Column, date: str, position: Column) -> DataFrame:
    """slug, name (as first written), count and latest date of each term."""
    return items.select(term.alias("slug"), name.alias("_name"), F.col(date).alias("_date"), position.alias("_at")).groupBy("slug").agg(
        F.min_by("_name", "_at").alias("name"), F.count("*").alias("count"), F.max("_date").alias("latest")
    )


def facets(items: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """kind, value, count of every facet value."""
    each = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v.cast("string"))])
    return items.select(F.explode(each).alias("kind", "value")).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("count"))


def agreed(column: str) -> Column:
    """A group's value where all rows agree, else null."""
    return F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count("*")), F.min(column))


def neighbours(items: DataFrame, order: list[Column], name: str, identity: str, within: str) -> DataFrame:
    """previous and next of each item, over neighbours of the same identity."""
    window = Window.partitionBy(within).orderBy(*order)
    changed = ~F.col(identity).eqNullSafe(F.lag(identity).over(window))
    before = F.when(changed, F.lag(name).over(window))
    turns = ~F.col(identity).eqNullSafe(F.lead(identity).over(window))
    after = F.when(turns, F.lead(name).over(window))
    marked = items.withColumns({"_b": before, "_c": changed, "_a": after, "_t": turns, "_nth": F.row_number().over(window)})
    # The value at the last change, itself perhaps null: wrapped so it counts.
    last = F.last(F.when(F.col("_c"), F.struct("_b")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    # Ahead is back in the reverse order: a frame that grows costs a row each.
    back = Window.partitionBy(within).orderBy(F.desc("_nth")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("_t"), F.struct("_a")), ignorenulls=True).over(back)
    return marked.withColumns({"previous": last["_b"], "next": first["_a"]}).drop("_b", "_c", "_a", "_t", "_nth")


def numbered(items: DataFrame, order: str) -> DataFrame:
    """items with ``nth`` from 0 in one order over all rows."""
    return running(items, [order], {"nth": F.lit(1)}).withColumn("nth", F.col("nth") - 1)
