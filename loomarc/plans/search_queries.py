"""Facets, postings and searches."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import archive, completion, ranking, search
from ..session import shared_path, written
from .registry import query, table
from .text_queries import _TOKENS


def _items(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


_ITEMS = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
_FACETS = """SELECT kind, value, count(*) AS count FROM (
  SELECT 'source' AS kind, source AS value FROM {0} UNION ALL SELECT 'lang', lang FROM {0}
  UNION ALL SELECT 'quality', quality::VARCHAR FROM {0} UNION ALL SELECT 'toxic', toxic::VARCHAR FROM {0}) WHERE value IS NOT NULL GROUP BY ALL"""
_KINDS = {k: F.col for k in ("source", "lang", "quality", "toxic")}


@query(_FACETS.format(_ITEMS))
def facet_catalogue(spark, sf):
    return archive.facets(_items(spark, sf), {k: f(k) for k, f in _KINDS.items()})


@query(_FACETS.format("(SELECT * FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND source <> 'src0')"))
def facet_counts_filtered(spark, sf):
    chosen = search.search(_items(spark, sf), search.parse("lang:en lang:de -source:src0"))
    return archive.facets(chosen, {k: f(k) for k, f in _KINDS.items()})


@query(f"SELECT t AS term, count(*) AS places, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents) GROUP BY t")
def term_postings(spark, sf):
    return search.postings(table(spark, sf, "documents").select("doc_id", "text")).groupBy("term").agg(
        F.count("*").alias("places"), F.count_distinct("doc_id").alias("documents")
    )


@lru_cache(maxsize=8)
def _built(application, spark, sf):
    docs = table(spark, sf, "documents").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7919 % 366).cast("int")))
    title = F.array_join(F.slice(tx.tokens(F.col("text")), 1, 8), " ")
    return ranking.build(docs, shared_path(spark, "search"), "doc_id", F.col("text"), title, F.col("source"), span=256)


def _index(spark, sf):
    """The stored index of documents, made once for an application and read by
    its searches; a document's title is its first eight words."""
    return _built(spark.sparkContext.applicationId, spark, sf)


_TERM = f"WITH t AS (SELECT doc_id, lang, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS s FROM documents) SELECT doc_id FROM t WHERE "


@query(_TERM + "contains(s, ' license ') AND contains(s, ' the ')")
def term_search(spark, sf):
    return ranking.matching(_index(spark, sf), search.parse("license the")).select("doc_id")


@query(_TERM + "contains(s, ' of the ')")
def phrase_search(spark, sf):
    return ranking.matching(_index(spark, sf), search.parse('"of the"')).select("doc_id")


@query(_TERM + "contains(s, ' the ') AND contains(s, ' license ') AND NOT contains(s, ' apache ') AND lang <> 'de'")
def exclude_search(spark, sf):
    return ranking.matching(_index(spark, sf), search.parse("the license -apache -lang:de")).select("doc_id")


def _ranked_sql(words: list[str], where: str, last: str) -> str:
    """The documented formula, over all documents."""
    counts = "len(list_filter({0}, lambda x: x = term))".format
    return f"""WITH t AS (SELECT *, {_TOKENS} AS w, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS s FROM documents),
about AS (SELECT count(*) AS items, avg(len(w)) AS mean FROM t),
places AS (SELECT doc_id, term, len(w) AS l, {counts("w")} + 12 * {counts("w[1:8]")} + 2 * (s = term)::INT AS n
  FROM t, (SELECT unnest({words}) AS term)),
terms AS (SELECT term, floor(1000000 * ln(1 + (any_value(items) - count(*) + 0.5) / (count(*) + 0.5)))::BIGINT AS rarity FROM places, about WHERE n > 0 GROUP BY term),
impacts AS (SELECT doc_id, term, floor(1000000 * (0.35 + 0.65 * (1.8 * n / (n + 0.8 * (0.65 + 0.35 * l / mean)))))::BIGINT AS impact FROM places, about WHERE n > 0),
scores AS (SELECT doc_id, sum(floor(rarity * impact / 1000000))::BIGINT AS score FROM impacts JOIN terms USING (term) GROUP BY doc_id HAVING count(*) = {len(words)}),
found AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores JOIN (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS text_ FROM t) USING (doc_id) WHERE {where})
SELECT doc_id, score, rank FROM found {last}"""


@query(_ranked_sql(["the", "license"], "true", "WHERE rank <= 50"))
def ranked_search(spark, sf):
    return ranking.ranked(_index(spark, sf), search.parse("the license"), 50)


@query(_ranked_sql(["the", "and"], "contains(text_, ' of the ') AND NOT contains(text_, ' apache ') AND lang = 'en'", "WHERE rank <= 50"))
def ranked_search_filtered(spark, sf):
    return ranking.ranked(_index(spark, sf), search.parse('the and "of the" -apache lang:en'), 50)


@query(_ranked_sql(["and", "license"], "true", "WHERE rank > ((SELECT count(*) FROM found) - 1) // 20 * 20"))
def last_search_page(spark, sf):
    return ranking.page(_index(spark, sf), search.parse("license and"), 1_000_000, 20, "day")[0]


_DAY = "DATE '2024-01-01' + (doc_id * 7919 % 366)::INT"


@query(
    f"""SELECT doc_id, NULL::BIGINT AS score, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY {_DAY} DESC, doc_id) AS rank
    FROM documents WHERE lang = 'fr' AND {_DAY} BETWEEN DATE '2024-03-01' AND DATE '2024-09-30') WHERE rank BETWEEN 11 AND 20"""
)
def newest_page(spark, sf):
    return ranking.page(_index(spark, sf), search.parse("lang:fr date:2024-03-01..2024-09-30"), 2, 10, "day")[0]


_LABELS = "(SELECT 'name' AS kind, c_name AS value, lower(c_mktsegment) || ' ' || c_custkey AS label, count(o_orderkey) AS count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"
_FRAGMENTS = ("7", "bu", "mac", "mer#0000", "ild 1")


def _names(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("count"))
    label = F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_custkey").cast("string"))
    names = table(spark, sf, "customer").join(orders, "c_custkey", "left")
    return names.select(F.lit("name").alias("kind"), F.col("c_name").alias("value"), label.alias("label"), F.coalesce("count", F.lit(0)).alias("count"))


@query(
    f"SELECT fragment, value, label, count FROM {_LABELS}, (SELECT unnest({list(_FRAGMENTS)}) AS fragment) WHERE contains(lower(label || ' ' || value), fragment)"
)
def label_completions(spark, sf):
    """Customers by parts of one, two, three and more letters of their names."""
    names = _names(spark, sf)
    index = written(completion.gram_index(names), "grams")
    found = [completion.completions(names, index, "name", f).select(F.lit(f).alias("fragment"), "value", "label", "count") for f in _FRAGMENTS]
    return reduce(lambda a, b: a.union(b), found)


@query(
    """WITH f AS (SELECT DISTINCT 'segment' AS kind, c_custkey::VARCHAR AS value, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS label FROM customer),
    n AS (SELECT 'segment' AS kind, unnest(name) AS name FROM (SELECT [upper(c_name), c_custkey::VARCHAR, lower(c_mktsegment), 'No ' || c_name] AS name FROM customer)),
    l AS (SELECT kind, lower(label) AS l, count(*) AS c, min(value) AS v FROM f GROUP BY ALL)
    SELECT n.kind, n.name, coalesce(f.value, CASE WHEN c = 1 THEN v END) AS value,
      CASE WHEN f.value IS NOT NULL OR c = 1 THEN NULL WHEN c > 1 THEN 'ambiguous' ELSE 'unknown' END AS problem
    FROM n LEFT JOIN (SELECT DISTINCT kind, value FROM f) f ON f.kind = n.kind AND f.value = n.name LEFT JOIN l ON l.kind = n.kind AND l.l = lower(n.name)"""
)
def resolved_facets(spark, sf):
    customers, key = table(spark, sf, "customer"), F.col("c_custkey").cast("string")
    label = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    facets = customers.select(F.lit("segment").alias("kind"), key.alias("value"), label.alias("label"))
    names = F.array(F.upper("c_name"), key, F.lower("c_mktsegment"), F.concat(F.lit("No "), "c_name"))
    return completion.resolved(customers.select(F.lit("segment").alias("kind"), F.explode(names).alias("name")), facets)
