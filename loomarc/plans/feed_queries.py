"""Feeds, cleaned pages, trimmed caches, matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import dates, urls
from ..functions import text as tx
from ..operators import state
from ..session import shared_path
from ..sinks import publish
from ..sources import feeds
from .registry import query, table

_SITE = "https://archive.example/"
_TOP = 20


def _sql_excerpt(most: int) -> str:
    head = f"substr(text, 1, {most})"
    whole = rf"regexp_extract({head}, '(?s)^(.+)\s', 1)"
    return rf"CASE WHEN length(text) <= {most} THEN text ELSE regexp_replace(CASE WHEN {whole} = '' THEN {head} ELSE {whole} END, '\s+$', '') || '…' END"


def _sql_escaped(value: str) -> str:
    for raw, name in tx.XML:
        value = "replace({}, '{}', '{}')".format(value, raw.replace("'", "''"), name)
    return value


def _element(name: str, value: str) -> str:
    return f"coalesce('<{name}>' || {_sql_escaped(value)} || '</{name}>', '')"


@query(
    f"""SELECT source, count(*) AS items, '<rss version="2.0"><channel>' || string_agg('<item>' || {_element("title", _sql_excerpt(60))} ||
    '<link>{_SITE}' || doc_id || '</link><guid>' || doc_id || '</guid>' || {_element("description", _sql_excerpt(240))} || '</item>', '' ORDER BY doc_id DESC)
    || '</channel></rss>' AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= {_TOP} GROUP BY source"""
)
def rss_collections(spark, sf):
    docs, text = table(spark, sf, "documents"), F.col("text")
    name = F.col("doc_id").cast("string")
    entry = sinks.rss_item(name, F.concat(F.lit(_SITE), name), tx.excerpt(text, 60), tx.excerpt(text), F.lit(None).cast("timestamp_ntz"))
    head, tail = F.lit('<rss version="2.0"><channel>'), F.lit("</channel></rss>")
    return sinks.collections(docs, "source", "doc_id", [F.desc("doc_id")], entry, head, tail, _TOP)


def _feed_files(spark, sf):
    """A folder of RSS, Atom and JSON feeds: the newest documents of each source."""
    docs, text, name = table(spark, sf, "documents"), F.col("text"), F.col("doc_id").cast("string")
    link, title, summary = F.concat(F.lit(_SITE), name), tx.excerpt(text, 60), tx.excerpt(text)
    day = F.expr("timestamp '2024-01-01 08:30:00' + make_dt_interval(int(doc_id % 366))")
    named = lambda what: F.concat(F.lit(what), F.col("source"), F.lit("</title>"))
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en"><title>'
    kinds = {
        "rss": (sinks.rss_item(name, link, title, summary, day), named('<?xml version="1.0"?><rss version="2.0"><channel><title>'), F.lit("</channel></rss>"), ""),
        "atom": (sinks.atom_entry(link, link, title, summary, day), named(atom), F.lit("</feed>"), ""),
        "json": (sinks.json_item(name, link, title, text, F.array("lang", "source")), F.concat(F.lit('{"title":"'), F.col("source"), F.lit('","items":[')), F.lit("]}"), ","),
    }
    folder = shared_path(spark, "feeds")
    for kind, (entry, head, tail, between) in kinds.items():
        rows = sinks.collections(docs, "source", "doc_id", [F.desc("doc_id")], entry, head, tail, _TOP, between)
        rows.select("source", F.regexp_replace("body", "[\\r\\n]", " ").alias("value")).repartition("source").write.partitionBy("source").text(f"{folder}/{kind}")
    return folder


_READ = "SELECT doc_id, source, lang, text, DATE '2024-01-01' + (doc_id % 366)::INT AS day FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 20"
_SEEN = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')".format


@query(
    f"""SELECT kind, doc_id, '{_SITE}' || doc_id AS link, coalesce({_SEEN(_sql_excerpt(60))}, 'archive.example') AS title, source AS feed,
    CASE WHEN kind <> 'json' THEN strftime(day, '%Y-%m-%d 08:30:00') END AS published, CASE WHEN kind <> 'json' THEN {_SEEN(_sql_excerpt(240))} END AS summary,
    CASE WHEN kind = 'json' THEN to_json([lang, source])::VARCHAR ELSE '[]' END AS labels
    FROM ({_READ}), (SELECT unnest(['rss', 'atom', 'json']) AS kind)"""
)
def feed_round_trip(spark, sf):
    """Feeds written by the sinks and read back by one reader."""
    items = feeds.feed_items(feeds.raw_entries(spark, _feed_files(spark, sf), glob="*.txt"))
    doc_id = F.substring_index("link", "/", -1).cast("long")
    kind = F.regexp_extract("file", "/(rss|atom|json)/source=", 1)
    stamp = F.date_format("published", "yyyy-MM-dd HH:mm:ss")
    return items.select(kind.alias("kind"), doc_id.alias("doc_id"), "link", "title", F.col("feed_title").alias("feed"), stamp.alias("published"), "summary", F.to_json("labels").alias("labels"))


@query(
    f"""SELECT doc_id, to_json({{'id': doc_id::VARCHAR, 'url': '{_SITE}' || doc_id, 'title': {_sql_excerpt(60)}, 'content_text': text, 'tags': [lang, source]}})::VARCHAR
    AS item FROM documents WHERE text IS NOT NULL"""
)
def json_feed_items(spark, sf):
    name, text = F.col("doc_id").cast("string"), F.col("text")
    item = sinks.json_item(name, F.concat(F.lit(_SITE), name), tx.excerpt(text, 60), text, F.array("lang", "source"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", item.alias("item"))


def _sql_without_active() -> str:
    quoted = lambda p: p.replace("'", "''")
    html = "html"
    for pattern in tx.ACTIVE_PATTERNS:
        html = f"regexp_replace({html}, '{quoted(pattern)}', '', 'g')"
    tag = "regexp_extract(x, '(?s)^[^>]*', 0)"
    for pattern in tx.ACTIVE_ATTRIBUTES:
        tag = f"regexp_replace({tag}, '{quoted(pattern)}', '', 'g')"
    rest = "regexp_extract(x, '(?s)^[^>]*(.*)$', 1)"
    return f"""SELECT page_id, array_to_string(list_concat(p[1:1], list_transform(p[2:], lambda x: {tag} || {rest})), '<') AS html
    FROM (SELECT page_id, string_split({html}, '<') AS p FROM pages)"""


@query(_sql_without_active())
def inactive_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.without_active(F.col("html")).alias("html"))


_LIMIT = 500_000_000


@query(
    f"""SELECT o_orderkey, size FROM (SELECT o_orderkey, size, sum(size) OVER () AS total,
    coalesce(sum(size) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM (SELECT o_orderkey, o_orderdate, floor(o_totalprice)::BIGINT AS size FROM orders)) WHERE total - earlier > {_LIMIT}"""
)
def trimmed_cache(spark, sf):
    files = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("size"))
    return state.trimmed(files, "size", "o_orderdate", "o_orderkey", _LIMIT).select("o_orderkey", "size")


@query(
    """WITH o AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%m-%d') AS day, any_value(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2 HAVING count(*) = 1),
    e AS (SELECT user_id, strftime(ts, '%m-%d') AS day, any_value(event_id) AS event_id FROM events GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT user_id, day, o_orderkey, event_id FROM o JOIN e USING (user_id, day)"""
)
def unique_day_matches(spark, sf):
    """One order and one event of a customer on the same day of the year."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "MM-dd").alias("day"), "o_orderkey")
    events = table(spark, sf, "events").select("user_id", F.date_format("ts", "MM-dd").alias("day"), "event_id")
    return state.unique_matches(orders, events, ["user_id", "day"]).select("user_id", "day", "o_orderkey", "event_id")


@query("SELECT user_id, event_type, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL")
def best_hits(spark, sf):
    """The highest value of each user and type; the later event wins a tie."""
    best = F.max_by("event_id", F.struct("value", "event_id"))
    return table(spark, sf, "events").where("value is not null").groupBy("user_id", "event_type").agg(best.alias("event_id"), F.max("value").alias("value"))


@query(
    r"""SELECT "group", value, count(*) AS items FROM (SELECT DISTINCT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(
    regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':[0-9]+$', ''), '\.$', ''), '^www\.', '') AS "group",
    unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS value FROM pages) GROUP BY ALL HAVING count(*) >= 3"""
)
def shared_links(spark, sf):
    """Links that three pages of a host or more have: its furniture."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return state.shared_values(table(spark, sf, "pages"), "page_id", urls.domain(F.col("url")), links)


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query(
    f"""SELECT told, count(*) AS items FROM (SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm'
    WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h' WHEN d < 45 THEN d::VARCHAR || 'd' WHEN d // 30 < 18 THEN (d // 30)::VARCHAR || 'mo'
    ELSE (d // 365)::VARCHAR || 'y' END AS told FROM (SELECT s, s // 86400 AS d FROM (SELECT floor(greatest(epoch_us({_NOW}) - epoch_us(ts), 0) / 1000000 + 0.5)::BIGINT AS s
    FROM events))) GROUP BY told"""
)
def relative_ages(spark, sf):
    told = dates.relative_text(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf, "events").groupBy(told.alias("told")).agg(F.count("*").alias("items"))


@query(
    r"""SELECT doc_id, nullif(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')), '') AS identity, lower(lang) || '-Latn-CH' AS tag
    FROM documents WHERE lang IS NOT NULL"""
)
def identity_keys(spark, sf):
    docs = table(spark, sf, "documents").where("lang is not null")
    return docs.select("doc_id", tx.identity_key(F.col("text")).alias("identity"), tx.language_tag(F.concat("lang", F.lit("_latn_ch"))).alias("tag"))


_BUCKET = "('0x' || substr(sha1(o_orderkey::VARCHAR), 1, 8))::BIGINT % 16"
_LINE = "to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})"


@query(
    f"""SELECT run, bucket, sha256(string_agg(row, '' ORDER BY row)) AS digest, count(*) AS rows, run = 0 OR bucket = (SELECT min({_BUCKET}) FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) AS written
    FROM (SELECT run, ({_BUCKET})::INT AS bucket, sha256({_LINE}::VARCHAR) AS row
      FROM (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN run = 1 AND o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, run FROM orders, range(2) t(run))) GROUP BY ALL"""
)
def published_buckets(spark, sf):
    """Orders published twice, one row changed between, in buckets named by
    their content: which of each version's were written."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = shared_path(spark, "published")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    status = F.when(F.col("o_orderkey") == first, "changed").otherwise(F.col("o_orderstatus"))
    publish.publish(orders, "o_orderkey", path, 16)
    before = publish.newest(spark, path).select(F.col("digest").alias("_before"))
    publish.publish(orders.withColumn("o_orderstatus", status), "o_orderkey", path, 16)
    new, old = publish.newest(spark, path), publish.newest(spark, path, 1)
    marked = new.join(before, new["digest"] == before["_before"], "left").withColumn("written", F.col("_before").isNull()).drop("_before")
    both = old.withColumn("written", F.lit(True)).unionByName(marked)
    return both.select(F.col("number").cast("long").alias("run"), "bucket", "digest", "rows", "written")
