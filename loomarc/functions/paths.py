"""Names and places of items in an archive, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import slug

#: Names that a common file system refuses (fixed values).
RESERVED = ("con", "prn", "aux", "nul", *[f"{kind}{k}" for kind in ("com", "lpt") for k in range(1, 10)])

MOST = 60


def file_stem(date: Column, title: Column, most: int = MOST) -> Column:
    """``yyyy-mm-dd-slug``: the slug is cut at a hyphen; a reserved or empty
    one is ``item``.  Letters beyond ASCII part words."""
    name = slug(title, "")
    head = F.substring(name, 1, most)
    at_word = F.regexp_extract(head, "^(.*)-", 1)
    cut = F.when(F.length(name) <= most, name).when(head.contains("-"), at_word).otherwise(head)
    cut = F.regexp_replace(cut, "^-+|-+$", "")
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("-"), F.when((cut == "") | cut.isin(*RESERVED), "item").otherwise(cut))


def unique_stems(items: DataFrame, folder: str, stem: str, identity: str, order: list[Column]) -> DataFrame:
    """items with ``name``: of those with one stem in a folder the first keeps
    it; others end in 8, 12, 16 or all digits of the sha1 of their identity,
    the fewest that are free, and then in a number."""
    nth = F.row_number().over(Window.partitionBy(folder, stem).orderBy(*order))
    digest = F.sha1(F.col(identity).cast("string"))
    numbered = items.withColumns({"nth": nth, "digest": digest, "head": F.substring(digest, 1, 8)})
    again = F.sum(F.when(F.col("nth") > 1, 1).otherwise(0)).over(
        Window.partitionBy(folder, stem, "head").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    width = F.when(F.col("again") <= 4, F.element_at(F.array(*map(F.lit, (8, 12, 16, 40))), F.greatest(F.col("again"), F.lit(1)).cast("int"))).otherwise(40)
    suffix = F.concat(F.lit("-"), F.substring(F.col("digest"), F.lit(1), width), F.when(F.col("again") > 4, F.concat(F.lit("-"), F.col("again") - 3)).otherwise(""))
    named = numbered.withColumn("again", again).withColumn("name", F.when(F.col("nth") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), suffix)))
    return named.drop("nth", "digest", "head", "again")


def item_folder(source: Column, date: Column) -> Column:
    return F.concat_ws("/", F.lit("items"), source, F.date_format(date, "yyyy"), F.date_format(date, "MM"))


def item_page(path: Column) -> Column:
    """``items/source/stem/`` of an item's path."""
    return F.concat(F.lit("items/"), F.coalesce(F.get(F.split(path, "/"), 1), F.lit("unknown")), F.lit("/"), F.substring_index(path, "/", -1), F.lit("/"))


def recency_bonus(newest: Column, date: Column) -> Column:
    """36 for the newest item, half of it a week before, in whole hours."""
    hours = F.greatest(F.lit(0), F.floor((F.unix_timestamp(newest) - F.unix_timestamp(date)) / 3600))
    return F.floor(36 * 168 / (168 + hours)).cast("long")
