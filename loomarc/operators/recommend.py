"""Greedy, diversified recommendations of every item, chosen in parallel.

Items stand newest first (ties by name).  An item's candidates are ranked by
the weight of the features they share; the ``pool`` newest items are candidates
of all, with a bonus for recency and one for another source.  An item takes
the first ``picks`` candidates that are neither itself nor a neighbour under
another name, nor another copy of one already taken, nor a newer item that has
taken this one.  Where too few are left, the newest items fill up, of other
sources first, and at last those which have taken this one.

Only the last rule depends on what others take, and only on newer ones, so
there is one solution.  All items choose side by side, again and again, each
seeing what was chosen the round before, until no choice changes: that is the
solution, after as many rounds as the longest chain of such dependences.  After
the first round only those choose again that are refused by others than before.

Candidates are bounded lists.  A list that may have been too short, or that
held too few copies of an article, is noticed, and such lists are made longer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import written
from . import archive
from .related import weighted_features


@dataclass(frozen=True)
class Recommending:
    """picks for an item, the pool of newest items and the bonus of another
    source; then what changes the cost and never the result: candidates kept
    for an item, of them copies of one article, newest items tried to fill up,
    how many items of a set of features all meet, and how many of an item's
    most common features are taken together to tell a score it surely gets.
    """

    picks: int = 3
    pool: int = 32
    other_source: int = 48
    keep: int = 24
    copies: int = 4
    front: int = 64
    common: int = 32
    listed: int = 12


def _newest() -> list[Column]:
    return [F.desc("date"), F.asc("name")]


def _sharing(ids: Column, weights: Column, its: Column) -> Column:
    """The weight of the features that an item has in common with another."""
    each = F.zip_with(ids, weights, lambda f, w: F.when(F.array_contains(its, f), w).otherwise(0))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, w: s + w)


#: More than any score: what an item surely gets that asks for no candidates.
_NEVER = 1 << 62


def _featured(items: DataFrame) -> DataFrame:
    """name, date, source, identity, ids and weights of the features that
    others have too, rarest first."""
    weighted = written(weighted_features(items.select("name", "features"), "name", F.col("features")).where("frequency > 1"), "features")
    numbers = weighted.groupBy("feature").agg(F.first("frequency").alias("frequency")).select("feature", F.struct("frequency", "feature").alias("at"))
    numbers = written(archive.numbered(numbers, "at").select("feature", F.col("nth").cast("int").alias("nth")), "numbers")
    has = weighted.join(numbers, "feature").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("nth", "weight"))).alias("has"))
    told = items.select("name", "date", "source", "identity").join(has, "name", "left")
    arrays = {"ids": F.coalesce("has.nth", F.array().cast("array<int>")), "weights": F.coalesce("has.weight", F.array().cast("array<bigint>"))}
    return written(told.withColumns(arrays).drop("has"), "described")


def _described(items: DataFrame, rule: Recommending) -> DataFrame:
    return _reaching(_featured(items), rule)


def _reaching(told: DataFrame, rule: Recommending, asking: DataFrame | None = None) -> DataFrame:
    """Featured items with ``least``, a score that ``keep`` candidates reach:
    those that have the item's most common features.  Where there is a table
    ``asking`` of names, others ask for no candidates."""
    last = F.explode(F.sequence(F.lit(1), F.least(F.size("ids"), F.lit(rule.listed)))).alias("last")
    ends = told.where(F.size("ids") > 0).select("name", "identity", "ids", "weights", last)
    end = lambda c: F.slice(c, F.size(c) - F.col("last") + 1, F.col("last"))
    ends = ends.select("name", "identity", end("ids").alias("set"), F.aggregate(end("weights"), F.lit(0).cast("long"), lambda s, w: s + w).alias("weight"))
    its = ends if asking is None else ends.join(asking, "name", "left_semi")
    if asking is not None:
        ends = ends.join(its.select("set").distinct(), "set", "left_semi")
    full = _counted(ends.withColumn("asks", F.lit(True)), rule).where("full").select("set")
    least = its.join(full, "set").groupBy("name").agg(F.max("weight").alias("least"))
    told = told.join(least, "name", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
    if asking is not None:
        told = told.join(asking.withColumn("asks", F.lit(True)), "name", "left")
        told = told.withColumn("least", F.when(F.col("asks"), F.col("least")).otherwise(_NEVER)).drop("asks")
    return written(told, "described")


def _counted(rows: DataFrame, rule: Recommending) -> DataFrame:
    """(set, asked, members, full) of sets: whether one of its items asks for
    candidates, and whether it has ``keep`` for any of its items, not counting
    more than ``copies`` of an article."""
    each = rows.groupBy("set", "identity").agg(F.count("*").alias("n"), F.bool_or("asks").alias("asks"))
    room = F.sum(F.least("n", F.lit(rule.copies))) >= rule.keep + rule.copies
    return each.groupBy("set").agg(F.bool_or("asks").alias("asked"), F.sum("n").alias("members"), room.alias("full"))


def _grown(rows: DataFrame) -> DataFrame:
    """Each item's sets with one more of its features, commoner than those in
    the set.  An item asks for a set's candidates where they may reach what it
    surely gets."""
    to = rows.where("at < size(ids)").withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.size("ids"))))
    to = to.withColumns({"set": F.concat("set", F.array(F.element_at("ids", F.col("at")))), "weight": F.col("weight") + F.element_at("weights", F.col("at"))})
    rest = F.aggregate(F.slice("weights", F.col("at") + 1, F.size("weights")), F.lit(0).cast("long"), lambda s, w: s + w)
    return to.withColumn("asks", F.col("weight") + rest >= F.col("least"))


def _met(described: DataFrame, rule: Recommending) -> DataFrame:
    """(name, candidate, score, date, identity): every pair that shares a
    feature and may be among an item's ``keep`` best, once.

    Sets of features grow from the rarest feature to the commonest, along
    those that more than ``common`` items have.  What two items share begins
    with one set at which growing ends: there they meet, as all its items do.
    Or all of it is a set of many items: then the newest of them are enough,
    as each of these shares as much as an older one that shares no more.
    """
    empty = {"set": F.array().cast("array<int>"), "at": F.lit(0), "weight": F.lit(0).cast("long")}
    grown = _grown(described.drop("source").withColumns(empty))
    few, many = [], []
    while True:
        sets = _counted(grown, rule).where("asked and members > 1").select("set", "full", (F.col("members") > rule.common).alias("many"))
        rows = written(grown.join(written(sets, "sets"), "set"), "sets")
        few.append(rows.where("not many"))
        if rows.where("many").isEmpty():
            break
        many.append(rows.where("many"))
        grown = _grown(many[-1].drop("full", "many"))
    other = lambda its: ~F.col(f"{its}.identity").eqNullSafe(F.col("identity"))
    both = lambda its: F.array_intersect("ids", f"{its}.ids")
    pairs = reduce(DataFrame.union, few).groupBy("set").agg(F.collect_list(F.struct("name", "date", "identity", "ids", "weights", "least", "asks")).alias("all"))
    pairs = pairs.select("set", "all", F.explode("all").alias("one")).where("one.asks").select("set", "one.*", F.explode("all").alias("its"))
    pairs = pairs.where(other("its") & (F.slice(both("its"), 1, F.size("set")) == F.col("set")))
    pairs = pairs.withColumn("score", _sharing(F.col("ids"), F.col("weights"), F.col("its.ids"))).where("score >= least")
    found = pairs.select("name", F.col("its.name").alias("candidate"), "score", "its.date", "its.identity")
    if not many:
        return found
    rows = reduce(DataFrame.union, many)
    asking = rows.where("asks and weight >= least").select("name", "identity", "ids", "set", "weight", "full")
    least = asking.where("full").groupBy("name").agg(F.max("weight").alias("least"))
    asking = written(asking.join(least, "name", "left").where("least is null or weight >= least"), "asking")
    heads = rows.join(asking.select("set").distinct(), "set", "left_semi").select("set", "name", "date", "identity", "ids")
    for keys, most in ((["set", "identity"], rule.copies), (["set"], rule.keep + rule.copies)):
        heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*_newest()))).where(F.col("nth") <= most).drop("nth")
    heads = heads.groupBy("set").agg(F.collect_list(F.struct("name", "date", "identity", "ids")).alias("heads"))
    first = asking.join(heads, "set").select("name", "identity", "ids", "set", "weight", F.explode("heads").alias("its"))
    first = first.where(other("its") & (both("its") == F.col("set")))
    return found.union(first.select("name", F.col("its.name").alias("candidate"), F.col("weight").alias("score"), "its.date", "its.identity"))


def ranked(items: DataFrame, rule: Recommending = Recommending()) -> DataFrame:
    """(name, rank, candidate, score, identity, date) of each item's ``keep``
    best candidates of another identity, ties newest first; from ``copies``
    copies of one article on, further ones may be left out.

    ``items``: name (unique), date, source, identity and features, the last an
    array of ``label:``, ``category:`` and other strings.
    """
    return _ranked(_described(items, rule), rule)


def _ranked(described: DataFrame, rule: Recommending) -> DataFrame:
    pool = written(described.orderBy(*_newest()).limit(rule.pool), "pool")
    met = _met(described, rule).join(F.broadcast(pool.select(F.col("name").alias("candidate"))), "candidate", "left_anti")
    newest = pool.agg(F.max("date").alias("newest"))  # one row
    its = pool.crossJoin(newest).select(
        F.col("name").alias("candidate"), "date", F.col("source").alias("its_source"), F.col("identity").alias("its_identity"),
        F.col("ids").alias("its_ids"), paths.recency_bonus(F.col("newest"), F.col("date")).alias("bonus"),
    )
    far = F.when(F.col("its_source").eqNullSafe(F.col("source")), 0).otherwise(rule.other_source)
    score = _sharing(F.col("ids"), F.col("weights"), F.col("its_ids")) + F.col("bonus") + far
    near = described.where(F.col("least") < _NEVER).drop("date").crossJoin(F.broadcast(its)).where(~F.col("its_identity").eqNullSafe(F.col("identity")))
    near = near.select("name", "candidate", score.cast("long").alias("score"), "date", F.col("its_identity").alias("identity"))
    full = met.select("name", "candidate", "score", "date", "identity").union(near)
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("date"), "candidate")
    full = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.keep)
    return full.select("name", "rank", "candidate", "score", "identity", "date")


def beside(items: DataFrame) -> DataFrame:
    """(name, previous, next, around): the nearest items before and after each,
    newest first, that are not the same article, and their identities.

    Rows are numbered by a range sort; a row beside a copy of its own article
    jumps on by where that one points, so a stretch of n copies takes log n
    rounds.
    """
    placed = items.select("name", "identity", F.struct((-F.unix_micros(F.col("date").cast("timestamp"))).alias("age"), "name").alias("at"))
    placed = written(archive.numbered(placed, "at").select("name", "identity", "nth"), "places")
    ends: dict[str, DataFrame] = {}
    for side, step in (("previous", -1), ("next", 1)):
        to = placed.withColumn("to", F.col("nth") + step)
        while True:
            there = to.select(F.col("nth").alias("to"), F.col("name").alias(side), F.col("identity").alias("its"), F.col("to").alias("further"))
            seen = written(to.join(there, "to", "left"), "beside")
            stays = F.col(side).isNull() | ~F.col("identity").eqNullSafe(F.col("its"))
            if seen.where(~stays).isEmpty():
                break
            to = seen.select("name", "identity", "nth", F.when(stays, F.col("to")).otherwise(F.col("further")).alias("to"))
        ends[side] = seen.select("name", side, F.col("its").alias(f"_{side}"))
    both = ends["previous"].join(ends["next"], "name")
    return both.select("name", "previous", "next", F.array_compact(F.array("_previous", "_next")).alias("around"))


def _choices(lists: DataFrame, front: DataFrame, rule: Recommending) -> DataFrame:
    """(name, date, keep, copies, size, refusing, picked, refused, tier): what
    each item takes, how many candidates of its list it was refused, and where
    its last one came from: 0 the list, 1 to 4 the newest items of other
    sources, of its own, and of both without the rule on what newer items took.
    Only items whose lists do not suffice go through the newest."""
    rows = lists.withColumn("apart", F.array_append("around", F.col("own_identity"))).crossJoin(F.broadcast(front))
    entry = lambda tier: lambda c: F.struct(c["candidate"].alias("candidate"), c["identity"].alias("identity"), F.lit(tier).alias("tier"))
    same = lambda c: c["source"].eqNullSafe(F.col("source"))
    others, own = F.filter("front", lambda c: ~same(c)), F.filter("front", same)
    listed = F.transform("ranked", entry(0))
    newest = F.concat(*[F.transform(group, entry(k)) for k, group in enumerate((others, own, others, own), 1)])
    kind = rows.select(listed.alias("listed")).schema["listed"].dataType.elementType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("picked"), F.lit(0).alias("refused"))

    def step(state: Column, c: Column) -> Column:
        fits = (F.size(state["picked"]) < rule.picks) & ~F.array_contains("apart", c["identity"]) & ~F.exists(state["picked"], lambda p: p["identity"] == c["identity"])
        refused = F.array_contains("refusing", c["candidate"])
        takes = fits & (~refused | (c["tier"] >= 3))
        return F.struct(
            F.when(takes, F.array_append(state["picked"], c)).otherwise(state["picked"]).alias("picked"),
            (state["refused"] + F.when(fits & refused & (c["tier"] == 0), 1).otherwise(0)).alias("refused"),
        )

    rows = rows.withColumn("end", F.aggregate(listed, start, step))
    rows = rows.withColumn("end", F.when(F.size("end.picked") < rule.picks, F.aggregate(newest, F.col("end"), step)).otherwise(F.col("end")))
    last = F.coalesce(F.get("end.picked", F.size("end.picked") - 1)["tier"], F.lit(4))
    tier = F.when(F.size("end.picked") < rule.picks, 4).otherwise(last)
    picked = F.transform("end.picked", lambda p: p["candidate"])
    return rows.select("name", "date", "keep", "copies", "size", "refusing", picked.alias("picked"), F.col("end.refused").alias("refused"), tier.alias("tier"))


def _before(one: str, its_date: str, other: str, date: str) -> Column:
    """Whether one item stands before another, newest first."""
    return (F.col(its_date) > F.col(date)) | ((F.col(its_date) == F.col(date)) & (F.col(one) < F.col(other)))


def recommend(items: DataFrame, rule: Recommending = Recommending()) -> tuple[DataFrame, int]:
    """(recommendations, rounds): name, previous, next and recommended (names,
    best first) of every item, and how many rounds the choices took.

    ``items`` as for :func:`ranked`, with no null name, date or identity.
    """
    items = written(items.select("name", "date", "source", "identity", "features"), "items")
    total = items.count()  # lists of so many hold everything
    sides = written(beside(items), "sides")
    own = items.select("name", "date", "source", F.col("identity").alias("own_identity")).join(sides.select("name", "around"), "name")
    featured = _featured(items)
    rounds, asking, lists, newer, made = 0, None, None, None, None
    while True:
        # Lists of all items, then longer ones of those whose list may have been too short.
        best = written(_ranked(_reaching(featured, rule, asking), rule), "ranked")
        entries = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "identity"))).alias("ranked"))
        made_now = (own if asking is None else own.join(asking, "name", "left_semi")).join(entries, "name", "left")
        kind = entries.schema["ranked"].dataType.simpleString()
        made_now = made_now.withColumn("ranked", F.coalesce("ranked", F.array().cast(kind)))
        made_now = made_now.withColumns({"size": F.size("ranked"), "keep": F.lit(rule.keep), "copies": F.lit(rule.copies)})
        # Only what newer items take can be refused.
        can = best.join(own.select("name", F.col("date").alias("own_date")), "name").where(_before("candidate", "date", "name", "own_date"))
        can = can.select("name", F.col("candidate").alias("by"))
        if asking is None:
            lists, newer = written(made_now, "lists"), written(can, "newer")
        else:
            lists = written(lists.join(asking, "name", "left_anti").unionByName(made_now), "lists")
            newer = written(newer.join(asking, "name", "left_anti").unionByName(can), "newer")
        newest = items.orderBy(*_newest()).limit(rule.front).select("date", F.col("name").alias("candidate"), "identity", "source")
        newest = written(newest, "front")
        place = F.struct((-F.unix_micros(F.col("date").cast("timestamp"))).alias("age"), "candidate", "identity", "source")
        front = written(newest.agg(F.array_sort(F.collect_list(place)).alias("front")), "front")
        none = F.array().cast(f"array<{newer.schema['by'].dataType.simpleString()}>")
        if asking is None:
            again = lists.select("name", none.alias("refusing"))
        else:
            again = made.join(asking, "name", "left_semi").select("name", "refusing")
        while True:
            rounds += 1
            chosen = _choices(lists.join(again, "name"), front, rule)
            made = written(chosen if made is None else made.join(again, "name", "left_anti").unionByName(chosen), "choices")
            taken = made.select(F.col("name").alias("by"), F.col("date").alias("by_date"), F.explode("picked").alias("name"))
            of_front = taken.join(F.broadcast(newest.select(F.col("candidate").alias("by"))), "by", "left_semi").join(items.select("name", "date"), "name")
            of_front = of_front.where(_before("by", "by_date", "name", "date"))
            blocked = newer.join(taken.select("name", "by"), ["name", "by"]).union(of_front.select("name", "by"))
            blocked = blocked.groupBy("name").agg(F.array_sort(F.collect_set("by")).alias("now"))
            again = made.select("name", "refusing").join(blocked, "name", "left").select("name", "refusing", F.coalesce("now", none).alias("now"))
            again = written(again.where("refusing <> now").select("name", F.col("now").alias("refusing")), "blocked")
            if again.isEmpty():
                break
        short = (F.col("tier") >= 1) & (F.col("size") >= F.col("keep"))
        unsure = (F.col("refused") >= F.col("copies")) | short | ((F.col("tier") >= 2) & F.lit(rule.front < total))
        asking = written(made.where(unsure).select("name"), "asking")
        if asking.isEmpty():
            return sides.join(made.select("name", F.col("picked").alias("recommended")), "name").drop("around"), rounds
        rule = replace(rule, keep=4 * rule.keep, copies=4 * rule.copies, front=4 * rule.front)
