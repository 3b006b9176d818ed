"""Facet values by a part of their label, and by the whole of it.

An index holds, for every value, the grams of its label and identifier: all
strings of one, two and three characters in it, each once.  A fragment of up to
three characters is a gram itself; a longer one meets the values that hold all
its grams of three, and only those are compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def searched(label: Column, value: Column) -> Column:
    """What a fragment is looked for in: label and identifier, lower-cased."""
    return F.lower(F.concat_ws(" ", label, value))


def grams(text: Column) -> Column:
    """The strings of one, two and three characters in a text, each once."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[of(n) for n in (1, 2, GRAM)]))


def gram_index(facets: DataFrame) -> DataFrame:
    """(gram, kind, value) of facets (kind, value, label), each once.

    The texts of a value come together before their grams are made, so no
    task has to tell grams apart but those of one value.
    """
    texts = facets.groupBy("kind", "value").agg(F.collect_set(searched(F.col("label"), F.col("value"))).alias("texts"))
    return texts.select(F.explode(F.array_distinct(F.flatten(F.transform("texts", grams)))).alias("gram"), "kind", "value")


def holding(index: DataFrame, kind: str, fragment: str) -> DataFrame:
    """(kind, value) of the values that hold all grams of a fragment."""
    text = fragment.lower()
    wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} or {text})
    met = index.where((F.col("kind") == kind) & F.col("gram").isin(wanted))
    return met.groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def completions(facets: DataFrame, index: DataFrame, kind: str, fragment: str) -> DataFrame:
    """The facets (kind, value, label, count) of a kind whose label or
    identifier holds the fragment; an empty one is held by all.

    Facets may carry the counts that another part of a query leaves; those at
    zero are then not among them.
    """
    found = facets.where(F.col("kind") == kind)
    if fragment:
        found = found.join(holding(index, kind, fragment), ["kind", "value"], "left_semi")
        found = found.where(F.contains(searched(F.col("label"), F.col("value")), F.lit(fragment.lower())))
    return found


def day_completions(days: DataFrame, fragment: str) -> DataFrame:
    """The published days (value, count) that begin with a fragment."""
    return days.where(F.startswith("value", F.lit(fragment)))


def resolved(named: DataFrame, facets: DataFrame) -> DataFrame:
    """named (kind, name) with ``value`` and ``problem``: an identifier wins,
    then a label (lower-cased) that only one value has; a label of several is
    ambiguous, and what is neither is unknown."""
    own = facets.select("kind", F.col("value").alias("name"), F.col("value").alias("_own")).distinct()
    label = facets.select("kind", F.lower("label").alias("_label"), "value").distinct().groupBy("kind", "_label").agg(F.count("*").alias("_n"), F.min("value").alias("_its"))
    found = named.withColumn("_label", F.lower("name")).join(own, ["kind", "name"], "left").join(label, ["kind", "_label"], "left")
    single = F.when(F.col("_n") == 1, F.col("_its"))
    problem = F.when(F.col("_own").isNotNull() | single.isNotNull(), None).when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return found.withColumns({"value": F.coalesce("_own", single), "problem": problem}).drop("_own", "_n", "_its", "_label")
