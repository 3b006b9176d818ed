"""License scans by a positional index of rare words.

Each template is a license phrase with the places of its words.  A file's
words that any template uses are its postings.  Their frequency over all
files gives every template its rarest words; files are looked up by these,
postings and template places are intersected by relative position, and a
template is reported only where every word of its key phrase stands at its
place.  Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Words of texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, base, phrase); "*" is any one word.  Fixed values.
TEMPLATES = (
    ("mit", True, "mit license"),
    ("apache", True, "apache license"),
    ("gpl", True, "general public license"),
    ("apache-2.0", False, "apache license version 2 0"),
    ("gpl-2.0", False, "gnu general public license version 2"),
    ("gpl-3.0", False, "gnu general public license version 3"),
    ("lgpl", False, "gnu lesser general public license"),
    ("agpl", False, "gnu affero general public license"),
    ("mpl", False, "mozilla public license"),
    ("epl", False, "eclipse public license"),
    ("isc", False, "isc license"),
    ("boost", False, "boost software license"),
    ("artistic", False, "artistic license"),
    ("cc-by-nc", False, "cc * nc"),
    ("cc-by-sa", False, "cc * sa"),
    ("cc-by-nd", False, "cc * nd"),
    ("cc", False, "creative commons attribution"),
    ("cc0", False, "cc0 1 0 universal"),
    ("mit-text", False, "permission * hereby granted free * charge * * person obtaining"),
    ("bsd-text", False, "redistribution * use * source * binary forms"),
    ("unlicense", False, "free * unencumbered software released"),
    ("warranty", False, "without warranties * conditions * * kind"),
)

#: Rarest words by which a template is looked up.
ANCHORS = 2


def lowered(text: Column) -> Column:
    """A-Z lower-cased; other letters may change case but never become ASCII
    (the Kelvin sign, which would, is put aside first)."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ÿ")))


def _places(spark: SparkSession) -> DataFrame:
    """template, label, base, need, place, word: a fixed table."""
    rows = []
    for at, (label, base, phrase) in enumerate(TEMPLATES):
        words = phrase.split(" ")
        need = sum(w != "*" for w in words)
        rows += [(at, label, base, need, k, w) for k, w in enumerate(words) if w != "*"]
    return spark.createDataFrame(rows, "template int, label string, base boolean, need int, place int, word string")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 - 0.5 ** places of any template.  Null and empty texts have no
    words and no labels; repeated rows each get a row; other columns are
    ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, _, phrase in TEMPLATES for w in phrase.split(" ")} - {"*"})
    index = (
        docs.select(
            F.xxhash64("doc_id", "text").alias("key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"),
        )
        .withColumn("all", F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)))
        .withColumn("at", F.filter("all", lambda i: F.get("words", i).isin(vocabulary)))
        .select(
            "key",
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.transform("at", lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word"))).alias("postings"),
        )
    )
    index = staged(index, "licenses")
    postings = (
        index.where("size(postings) > 1")
        .dropDuplicates(["key"])
        .select("key", F.explode("postings").alias("p"))
        .select("key", "p.at", "p.word")
    )
    places = F.broadcast(_places(spark))  # a fixed table
    frequency = postings.select("key", "word").distinct().groupBy("word").agg(F.count("*").alias("files"))
    rarest = Window.partitionBy("template").orderBy("files", "word", "place")
    anchors = (
        _places(spark)
        .join(frequency, "word")
        .withColumn("nth", F.row_number().over(rarest))
        .where(F.col("nth") <= ANCHORS)
        .select("template", "place", "word", F.least("need", F.lit(ANCHORS)).alias("anchors"))
    )
    met = (
        postings.join(F.broadcast(anchors), "word")  # at most ANCHORS rows a template
        .groupBy("key", "template", (F.col("at") - F.col("place")).alias("start"), "anchors")
        .agg(F.count("*").alias("got"))
        .where("got = anchors and start >= 0")
    )
    verified = (
        met.select("key", "template", "start")
        .join(places, "template")
        .select("key", "template", "label", "base", "need", "start", (F.col("start") + F.col("place")).alias("at"), "word")
        .join(postings, ["key", "at", "word"], "left_semi")
        .groupBy("key", "template", "label", "base", "need", "start")
        .agg(F.count("*").alias("got"))
        .where("got = need")
    )
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = verified.groupBy("key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.count("*").alias("n_all"),
    )
    return index.select("key", "doc_id", "n_words").join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        (1 - F.pow(F.lit(0.5), F.coalesce("n_all", F.lit(0)))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`license_scan` over ``documents``."""
    counted, names, base_names, starts = [], [], [], []
    for at, (label, base, phrase) in enumerate(TEMPLATES):
        test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(" ")) if word != "*")
        # A gap at the end of a phrase never occurs, so every place is inside.
        counted.append(f"list_filter(r, lambda i: coalesce({test}, false)) AS p{at}")
        names.append(f"CASE WHEN len(p{at}) > 0 THEN '{label}' END")
        if base:
            base_names.append(names[-1])
            starts.append(f"p{at}")
    every = " + ".join(f"len(p{at})" for at in range(len(TEMPLATES)))
    labels = "coalesce(array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ','), '')"
    return f"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    ranged AS (SELECT doc_id, w, range(1, len(w) + 1) AS r FROM words),
    placed AS (SELECT doc_id, len(w) AS n_words, {', '.join(counted)} FROM ranged),
    based AS (SELECT *, list_concat({starts[0]}, {', '.join(starts[1:])}) AS s FROM placed)
    SELECT doc_id, n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT - 1 AS first_word,
      list_max(s)::BIGINT - 1 AS last_word, {labels.format(', '.join(base_names))} AS base_labels,
      {labels.format(', '.join(names))} AS labels, 1 - pow(0.5, {every}) AS score
    FROM based"""
