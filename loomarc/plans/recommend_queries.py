"""Recommendations of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import recommend
from .registry import query, table
from .text_queries import _TOKENS, _WORDS


def _items(spark, sf):
    """Documents as items: a language and a source, the first eight words as a
    title, one article where texts of 64 words agree, dates with ties."""
    docs = table(spark, sf, "documents")
    title = F.array_join(F.slice(tx.tokens(F.col("text")), 1, 8), " ")
    terms = F.transform(tx.title_terms(title), lambda t: F.concat(F.lit("title:"), t))
    features = F.concat(F.array(F.concat(F.lit("label:"), "lang"), F.concat(F.lit("category:"), "source")), terms)
    day = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(int(doc_id * 7919 % 366), int(doc_id * 31 % 3))")
    identity = F.coalesce(tx.fingerprint(F.col("text")), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("name"), day.alias("date"), "source", identity.alias("identity"), features.alias("features"))


@query(
    f"""WITH d AS (SELECT doc_id, source, lang, {_WORDS} AS ws, {_TOKENS} AS w,
      TIMESTAMP '2024-01-01' + to_days((doc_id * 7919 % 366)::INT) + to_hours((doc_id * 31 % 3)::INT) AS date FROM documents),
    i AS (SELECT doc_id, source, date, coalesce(CASE WHEN len(ws) >= 64 THEN sha1(array_to_string(ws, ' ') || ' ') END, doc_id::VARCHAR) AS identity,
      list_distinct(['label:' || lang, 'category:' || source] || list_transform(list_filter(regexp_split_to_array(lower(array_to_string(w[1:8], ' ')), '[^\\p{{L}}\\p{{N}}]+'),
        lambda t: length(t) >= 3 AND t NOT IN {tx.STOPWORDS}), lambda t: 'title:' || t)) AS fs FROM d),
    e AS (SELECT doc_id, unnest(fs) AS f FROM i),
    g AS (SELECT f, CASE WHEN starts_with(f, 'label:') THEN 100 WHEN starts_with(f, 'category:') THEN 40 ELSE 8 + least(48, (SELECT count(*) FROM i) * 20 // count(*)) END AS weight FROM e GROUP BY f),
    s AS (SELECT a.doc_id AS name, b.doc_id AS candidate, sum(weight) AS score FROM e a JOIN e b USING (f) JOIN g USING (f) GROUP BY ALL),
    pool AS (SELECT doc_id, source, date FROM i ORDER BY date DESC, doc_id LIMIT 32),
    p AS (SELECT i.doc_id AS name, pool.doc_id AS candidate, (36 * 168) // (168 + date_diff('second', pool.date, (SELECT max(date) FROM i)) // 3600)
      + CASE WHEN pool.source = i.source THEN 0 ELSE 48 END AS score FROM i, pool),
    u AS (SELECT name, candidate, sum(score)::BIGINT AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM p) GROUP BY ALL)
    SELECT name, candidate, score, rank FROM (SELECT u.*, row_number() OVER (PARTITION BY name ORDER BY score DESC, c.date DESC, candidate) AS rank
      FROM u JOIN i n ON n.doc_id = name JOIN i c ON c.doc_id = candidate WHERE n.identity <> c.identity) WHERE rank <= 12"""
)
def ranked_candidates(spark, sf):
    return recommend.ranked(_items(spark, sf), recommend.Recommending(keep=12, copies=12)).select("name", "candidate", "score", "rank")


@query()
def recommendations(spark, sf):
    return recommend.recommend(_items(spark, sf))[0]
