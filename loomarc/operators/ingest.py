"""The plan of an ingest: which entries of a run are added, readmitted, taken
as updates of archived items, or passed over.

An entry has keys, best first, and is the same as another of its source when
they share one.  Entries are taken oldest first, and one that is added makes
its keys known to the later ones, so what happens to an entry depends on what
happened to those it shares keys with.  Rounds settle that side by side: an
entry that shares a key with one already taken before it is passed over; one
that is, for each of its keys, the first still open or taken is taken.  Every
round settles the first open entry of each key at least, and works on keys, so
a key that most entries share costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def limited(entries: DataFrame, source: str, at: str, now: Column, cutoff: Column, most: Column, name: str) -> DataFrame:
    """Entries not older than the source's cutoff, and of those the ``most``
    newest of each source; an entry without a time is of now, and null or zero
    is no limit."""
    when = F.coalesce(F.col(at), now)
    kept = entries.where(F.coalesce(when >= cutoff, F.lit(True)))
    nth = F.row_number().over(Window.partitionBy(source).orderBy(when.desc(), F.asc(name)))
    kept = kept.withColumn("_nth", nth).withColumn("_most", most)
    return kept.where(F.coalesce((F.col("_most") <= 0) | (F.col("_nth") <= F.col("_most")), F.lit(True))).drop("_nth", "_most")


def archived_paths(entries: DataFrame, existing: DataFrame, name: str, source: str, keys: str) -> DataFrame:
    """(name, path): the archived path of each entry by the best of its keys
    that has one.  ``existing``: source, key, path."""
    each = entries.select(name, source, F.posexplode(keys).alias("_at", "key"))
    return each.join(existing, [source, "key"]).groupBy(name).agg(F.min_by("path", "_at").alias("path"))


def _taken(keys: DataFrame) -> DataFrame:
    """(nth) of the entries taken; keys: nth, key, and ``again`` for those
    readmitted, which only other readmitted ones can stand before."""
    taken = keys.select("nth").limit(0)
    waiting = written(keys, "waiting")
    while not waiting.isEmpty():
        first = waiting.groupBy("key").agg(F.min("nth").alias("first"), F.min(F.when(F.col("again"), F.col("nth"))).alias("again_first"))
        leads = F.col("nth") == F.when(F.col("again"), F.col("again_first")).otherwise(F.col("first"))
        won = waiting.join(first, "key").groupBy("nth").agg(F.every(leads).alias("leads")).where("leads").select("nth")
        won = written(won, "won")
        taken = taken.union(won)
        gone = won.union(_beaten(waiting, waiting.join(won, "nth"))).distinct()
        waiting = written(waiting.join(gone, "nth", "left_anti"), "waiting")
    return taken


def _beaten(keys: DataFrame, won: DataFrame) -> DataFrame:
    """(nth) of entries that share a key with one taken before them."""
    claims = won.groupBy("key").agg(F.min("nth").alias("by"), F.min(F.when(F.col("again"), F.col("nth"))).alias("again_by"))
    return keys.join(claims, "key").where(F.col("nth") > F.when(F.col("again"), F.col("again_by")).otherwise(F.col("by"))).select("nth")


def plan(entries: DataFrame, seen: DataFrame, existing: DataFrame, evicted: DataFrame, links: DataFrame, name: str, source: str, at: str) -> DataFrame:
    """entries with ``action`` and ``path``.

    add: no key was seen, and no other source has the link.  readmit: keys were
    seen and one was evicted under another policy than now, and nothing is
    archived under them.  update: archived at ``path``.  known: seen, or the
    same as an entry taken before.  elsewhere: the link is archived already.

    entries: name (a long, unique), source, time, link and ``keys`` (array, best
    first); seen: source, key; existing: source, key, path; evicted: source, key
    (those whose policy has changed); links: link.  Entries go by time, then
    name; one without keys is added.
    """
    each = entries.select(name, source, F.explode("keys").alias("key")).distinct()
    flag = lambda table, as_: each.join(table.select(source, "key").distinct(), [source, "key"], "left_semi").select(name).distinct().withColumn(as_, F.lit(True))
    marked = entries.join(flag(seen, "_seen"), name, "left").join(flag(evicted, "_evicted"), name, "left")
    marked = marked.join(archived_paths(entries, existing, name, source, "keys"), name, "left")
    marked = marked.join(links.select("link").distinct().withColumn("_elsewhere", F.lit(True)), "link", "left")
    once = F.coalesce(F.col("_seen"), F.lit(False))
    again = once & F.col("path").isNull() & F.coalesce(F.col("_evicted"), F.lit(False))
    away = F.col("_elsewhere").isNotNull()
    marked = written(marked.withColumns({"_again": again, "_open": ~once | again}), "entries")
    keys = marked.where("_open").select(F.struct(at, name).alias("nth"), F.explode(F.array_distinct("keys")).alias("key"), F.col(source).alias("_source"), F.col("_again").alias("again"), away.alias("away"))
    keys = written(keys.select("nth", F.struct("_source", "key").alias("key"), "again", "away"), "keys")
    won = written(_taken(keys.where("not away").drop("away")), "taken")
    beaten = _beaten(keys.where("away"), keys.join(won, "nth")).distinct()
    named = lambda some, as_: some.select(F.col("nth")[name].alias(name)).withColumn(as_, F.lit(True))
    found = marked.join(named(won, "_won"), name, "left").join(named(beaten, "_beaten"), name, "left")
    takes = F.col("_open") & ~away & (F.col("_won").isNotNull() | (F.size("keys") == 0))
    action = (
        F.when(takes, F.when(F.col("_again"), "readmit").otherwise("add"))
        .when(F.col("path").isNotNull() & once, "update")
        .when(F.col("_open") & away & F.col("_beaten").isNull(), "elsewhere")
        .otherwise("known")
    )
    return found.withColumn("action", action).withColumn("path", F.when(F.col("action") == "update", F.col("path"))).drop("_seen", "_evicted", "_elsewhere", "_again", "_open", "_won", "_beaten")
