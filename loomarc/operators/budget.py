"""Admission to a budget in one order, skipping what does not fit.

Going through families one after another, each is admitted if the parts of it
that nothing admitted has yet fit into what is left.  Here rounds do it.  If
all that wait were admitted, a part would be paid for by the first family that
holds it.  So counted,

* a family that costs more than what is left can never fit, as only its own
  earlier ones could make it cheaper and they are counted already: it goes;
* of the others the longest run from the first on that fits as a whole is
  admitted, and the one after it goes.

What goes leaves its shared parts to later ones, so the costs of the next round
are counted again.  Peeled so, a part that many hold would take a round for
each.  So before that, once something is admitted,

* a family goes if all its parts that are not paid for yet, at the least that
  any family names for them, come to more than what is left: if it were
  admitted, it and those before it would pay for them all out of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scans import running


def admitted(families: DataFrame, name: str, order: list[str], parts: Column, limit: int) -> tuple[DataFrame, int]:
    """(families, rounds): name, admitted and cost (of admitted ones) of every
    family, and the rounds taken.

    ``order`` tells families apart.  ``parts``: array of structs of path and
    bytes; a path counts once, within a family as last named, and is paid for
    by the first family admitted that holds it.  No parts cost nothing.
    """
    placed = running(families.select(*dict.fromkeys([name, *order]), parts.alias("_parts")), order, {"nth": F.lit(1)})
    placed = written(placed.select(name, "nth", "_parts"), "families")
    each = placed.select("nth", F.posexplode("_parts").alias("at", "part")).select("nth", "at", "part.path", "part.bytes")
    each = written(each.groupBy("nth", "path").agg(F.max_by("bytes", "at").alias("bytes")), "parts")
    least = written(each.groupBy("path").agg(F.min("bytes").alias("least")), "least")
    waiting, left, rounds, done = placed.select("nth"), limit, 0, []
    while True:
        rounds += 1
        owners = each.groupBy("path").agg(F.min(F.struct("nth", "bytes")).alias("first")).groupBy("first.nth").agg(F.sum("first.bytes").alias("cost"))
        costs = written(waiting.join(owners, "nth", "left").select("nth", F.coalesce("cost", F.lit(0)).alias("cost")), "costs")
        if costs.isEmpty():
            break
        fits = costs.where(F.col("cost") <= left)
        if fits.count() < costs.count():
            waiting = fits.select("nth")
            each = written(each.join(waiting, "nth", "left_semi"), "parts")
            continue
        whole = written(running(costs, ["nth"], {"total": F.col("cost")}), "running")
        over = whole.where(F.col("total") > left).agg(F.min("nth")).first()[0]
        taken = whole.where(F.col("nth") < over) if over is not None else whole
        taken = written(taken.select("nth", "cost"), "taken")
        left -= taken.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
        done.append(taken)
        if over is None:
            break
        waiting = whole.where(F.col("nth") > over).select("nth")
        paid = each.join(taken, "nth", "left_semi").select("path").distinct()
        left_over = written(each.join(waiting, "nth", "left_semi").join(paid, "path", "left_anti"), "parts")
        dear = left_over.join(least, "path").groupBy("nth").agg(F.sum("least").alias("cost")).where(F.col("cost") > left)
        waiting = written(waiting.join(dear, "nth", "left_anti"), "waiting")
        each = written(left_over.join(waiting, "nth", "left_semi"), "parts")
    found = placed.select(name, "nth")
    taken = done[0] if done else waiting.limit(0).withColumn("cost", F.lit(0).cast("long"))
    for more in done[1:]:
        taken = taken.union(more)
    return found.join(taken, "nth", "left").select(name, F.col("cost").isNotNull().alias("admitted"), "cost"), rounds
