"""Reading metrics, excerpts, HTML to text, containment, pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query, table

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS words, ceil(len({_WORDS}) / 225)::BIGINT AS minutes FROM documents")
def reading_metrics(spark, sf):
    n = F.size(tx.words(F.col("text"))).cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("words"), tx.reading_minutes(n).alias("minutes"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(CASE WHEN regexp_extract(h, '(?s)^(.+)\s', 1) = '' THEN h
    ELSE regexp_extract(h, '(?s)^(.+)\s', 1) END, '\s+$', '') || '…' END AS excerpt FROM (SELECT *, substr(text, 1, 240) AS h FROM documents)"""
)
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.collapsed(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages"""
)
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))::BIGINT AS links, array_to_string(list_slice(
    regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1, 16), ' ') AS first_links FROM pages""")
def page_links(spark, sf):
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.array_join(F.slice(found, 1, 16), " ").alias("first_links"))


_TOKENS = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g'))), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d),
    bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b),
    t AS (SELECT item_id, count(*) AS total FROM bs GROUP BY 1)
    SELECT item_id, doc_id, count(*) AS present, any_value(total) AS total FROM ds JOIN bs USING (g) JOIN t USING (item_id) GROUP BY item_id, doc_id
    HAVING count(*) >= 3 OR 2 * count(*) >= any_value(total)"""
)
def shingle_containment(spark, sf):
    """Which pages hold a feed entry's words: shingles of eight, joined."""

    def grams(df, name):
        w = tx.tokens(F.col("text"))
        some = df.select(name, w.alias("w")).where("size(w) >= 8")
        each = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
        return some.select(name, F.explode(F.array_distinct(each)).alias("g"))

    items = grams(table(spark, sf, "benchmark"), "item_id")
    totals = items.groupBy("item_id").agg(F.count("*").alias("total"))
    met = grams(table(spark, sf, "documents"), "doc_id").join(items, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("present"))
    return met.join(totals, "item_id").where("present >= 3 or 2 * present >= total")


@query(
    """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)) AS g FROM embeddings),
    c AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i])))::BIGINT // 64 AS distance
    FROM q a JOIN q b ON b.vec_id = a.vec_id + 1) SELECT vec_id, other, distance, distance <= 12 AS same FROM c"""
)
def picture_distances(spark, sf):
    """Mean distance of 8x8 grids between each picture and the next one."""
    grids = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("g"))
    other = grids.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("g").alias("h"))
    apart = F.aggregate(F.zip_with("g", "h", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return grids.join(other, "vec_id").select("vec_id", "other", apart.alias("sum")).select(
        "vec_id", "other", F.expr("sum div 64").alias("distance"), F.expr("sum div 64 <= 12").alias("same")
    )
