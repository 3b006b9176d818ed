"""Links, canonical articles, retention, paging, taxonomies, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, urls
from ..functions import text as tx
from ..operators import archive, identity, related
from .registry import query, table

_LINKS = f"WITH links AS ({urls.CANONICAL_SQL})"
_DOMAIN = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '://([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\.', '')"
_FINGER = r"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT *, CASE WHEN len(ws) >= 64 THEN sha1(array_to_string(ws, ' ') || ' ') END AS fingerprint FROM w)"""


@query(_LINKS + " SELECT page_id, link FROM links")
def canonical_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_link(F.col("url")).alias("link"))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def link_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(
    f"""{_LINKS}, c AS (SELECT l.*, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY link ORDER BY strlen(html) DESC, l.page_id) AS nth
    FROM links l JOIN (SELECT page_id, html FROM pages) p ON p.page_id = l.page_id)
    SELECT page_id, link, domain, (row_number() OVER (PARTITION BY domain ORDER BY page_id DESC) - 1) // 20 + 1 AS page,
    (row_number() OVER (PARTITION BY domain ORDER BY page_id DESC) - 1) % 20 AS "offset" FROM c WHERE nth = 1"""
)
def river_pages(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", urls.canonical_link(F.col("url")).alias("link"), urls.domain(F.col("url")).alias("domain"), F.octet_length("html").alias("bytes")
    )
    chosen = archive.canonical(pages, "link", [F.desc("bytes"), F.asc("page_id")])
    return archive.paged(chosen, [F.desc("page_id")], 20, "domain").drop("bytes")


@query(
    f"""{_LINKS} SELECT link AS anchor, count(*) AS snapshots, min(page_id) AS first_page,
    array_to_string(list_sort(list(url)), ' ') AS urls FROM links GROUP BY link"""
)
def linkset(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", urls.canonical_link(F.col("url")).alias("anchor"))
    return pages.groupBy("anchor").agg(
        F.count("*").alias("snapshots"), F.min("page_id").alias("first_page"), F.array_join(F.array_sort(F.collect_list("url")), " ").alias("urls")
    )


@query(
    f"""{_LINKS} SELECT page_id, to_json(['link', sha1('link:' || link)])::VARCHAR AS keys FROM links"""
)
def dedupe_key_rows(spark, sf):
    pages = table(spark, sf, "pages")
    none = F.lit(None).cast("string")
    keys = urls.dedupe_keys(none, F.col("url"), none, F.lit(None).cast("timestamp_ntz"))
    return pages.select("page_id", F.to_json(F.array_insert(keys, 1, "link")).alias("keys"))


@query(
    r"""SELECT page_id, CASE WHEN e IN ('mp4','m4v','webm','mov','ogv') OR h IN ('youtube.com','m.youtube.com','youtu.be','vimeo.com','twitch.tv') THEN 'video'
    WHEN e = 'pdf' THEN 'document' WHEN e IN ('mp3','m4a','ogg','oga','opus','wav','flac','aac') THEN 'audio'
    WHEN e IN ('jpg','jpeg','png','gif','webp','avif','svg') THEN 'image' ELSE 'article' END AS type
    FROM (SELECT page_id, lower(regexp_extract(regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS e,
    """
    + _DOMAIN
    + " AS h FROM pages)"
)
def item_types(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.item_type(F.col("url"), F.lit(None).cast("string")).alias("type"))


@query(f"SELECT {_DOMAIN} AS host, min(split_part(url, '://', 2)) AS root, count(*) AS pages FROM pages GROUP BY 1")
def host_publishers(spark, sf):
    pages = table(spark, sf, "pages").select(urls.domain(F.col("url")).alias("host"), F.substring_index("url", "://", -1).alias("root"))
    return pages.groupBy("host").agg(F.min("root").alias("root"), F.count("*").alias("pages"))


@query(f"{_LINKS} SELECT (row_number() OVER (ORDER BY link) - 1) // 100 AS chunk, link AS loc, max(page_id) AS lastmod FROM links GROUP BY link")
def sitemap_chunks(spark, sf):
    """Chunks of 100 URLs; places come from a range sort and partition counts."""
    locs = table(spark, sf, "pages").groupBy(urls.canonical_link(F.col("url")).alias("loc")).agg(F.max("page_id").alias("lastmod"))
    return archive.numbered(locs, "loc").select(F.expr("nth div 100").alias("chunk"), "loc", "lastmod")


@query(_FINGER + " SELECT doc_id, fingerprint FROM f WHERE fingerprint IS NOT NULL")
def fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint")).where("fingerprint is not null")


@query(
    _FINGER
    + """ SELECT doc_id, source FROM (SELECT *, CASE WHEN fingerprint IS NULL THEN 1 ELSE row_number()
    OVER (PARTITION BY fingerprint ORDER BY strlen(text) DESC, doc_id) END AS nth FROM f) WHERE nth = 1"""
)
def canonical_articles(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes"), tx.fingerprint(F.col("text")).alias("fingerprint"))
    return archive.canonical(docs, "fingerprint", [F.desc("bytes"), F.asc("doc_id")]).select("doc_id", "source")


@query(
    _FINGER
    + """ SELECT doc_id AS loser, winner FROM (SELECT doc_id, first(doc_id) OVER (PARTITION BY fingerprint ORDER BY strlen(text) DESC, doc_id) AS winner
    FROM f WHERE fingerprint IS NOT NULL) WHERE doc_id <> winner"""
)
def duplicate_redirects(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"), tx.fingerprint(F.col("text")).alias("fingerprint"))
    return archive.redirects(docs, "fingerprint", "doc_id", [F.desc("bytes"), F.asc("doc_id")])


_RETAINED = """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders),
r AS (SELECT *, row_number() OVER w AS nth, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM o
  WINDOW w AS (PARTITION BY o_custkey, old ORDER BY o_orderdate DESC, o_orderkey)),
d AS (SELECT o_orderkey, o_custkey, CASE WHEN old THEN 'age' WHEN nth > 5 THEN 'count' WHEN run > 80000000 THEN 'bytes' END AS reason FROM r)"""


def _retention(spark, sf):
    orders = table(spark, sf, "orders").withColumn("bytes", F.round(F.col("o_totalprice") * 100).cast("long"))
    cutoff = F.lit("1996-01-01").cast("timestamp_ntz")
    return archive.retention(orders, "o_custkey", "o_orderdate", "o_orderkey", "bytes", cutoff, F.lit(5), F.lit(80_000_000))


@query(_RETAINED + " SELECT o_orderkey, o_custkey FROM d WHERE reason IS NULL")
def retained_orders(spark, sf):
    return _retention(spark, sf).where("reason is null").select("o_orderkey", "o_custkey")


@query(_RETAINED + " SELECT o_orderkey, reason FROM d WHERE reason IS NOT NULL")
def evicted_orders(spark, sf):
    return _retention(spark, sf).where("reason is not null").select("o_orderkey", "reason")


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01') WHERE nth <= 3"""
)
def home_window(spark, sf):
    orders = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz"))
    return archive.first_page(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "o_custkey").select("o_custkey", "o_orderkey")


def _taxonomy_sql(name: str) -> str:
    return f"SELECT lower({name}) AS slug, arg_min({name}, doc_id) AS name, count(*) AS count, max(doc_id) AS latest FROM documents GROUP BY 1"


@query(_taxonomy_sql("lang"))
def taxonomy_lang(spark, sf):
    return archive.taxonomy(table(spark, sf, "documents"), tx.slug(F.col("lang")), F.col("lang"), "doc_id", F.col("doc_id"))


@query(_taxonomy_sql("source"))
def taxonomy_source(spark, sf):
    return archive.taxonomy(table(spark, sf, "documents"), tx.slug(F.col("source")), F.col("source"), "doc_id", F.col("doc_id"))


@query(
    """SELECT n_name AS source, count(c_custkey) AS members, max(c_acctbal) AS latest, r_name AS category
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name"""
)
def source_contexts(spark, sf):
    sources = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.max("c_acctbal").alias("latest"))
    return sources.join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("source"), F.coalesce("members", F.lit(0)).alias("members"), "latest", F.col("r_name").alias("category")
    )


@query(
    """SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS segment, min(c_name) AS first_name,
    count(*) AS feeds FROM customer GROUP BY c_nationkey"""
)
def grouped_feeds(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        archive.agreed("c_mktsegment").alias("segment"), F.min("c_name").alias("first_name"), F.count("*").alias("feeds")
    )


@query(
    """WITH w AS (SELECT *, lag(o_orderkey) OVER k AS b, lead(o_orderkey) OVER k AS a, lag(o_orderstatus) OVER k AS bs, lead(o_orderstatus) OVER k AS as_ FROM orders
    WINDOW k AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    m AS (SELECT *, bs IS DISTINCT FROM o_orderstatus AS c, as_ IS DISTINCT FROM o_orderstatus AS t FROM w),
    g AS (SELECT *, sum(c::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT o_orderkey, max(CASE WHEN c THEN b END) OVER (PARTITION BY o_custkey, run) AS previous,
    max(CASE WHEN t THEN a END) OVER (PARTITION BY o_custkey, run) AS next FROM g"""
)
def neighbours(spark, sf):
    out = archive.neighbours(table(spark, sf, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderkey", "o_orderstatus", "o_custkey")
    return out.select("o_orderkey", "previous", "next")


_FEATURES = f"""WITH p AS (SELECT p_partkey, list_distinct(['label:' || p_brand, 'category:' || p_type] ||
  list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {tx.STOPWORDS}), lambda t: 'title:' || t)) AS fs FROM part),
e AS (SELECT p_partkey, unnest(fs) AS feature FROM p),
w AS (SELECT feature, count(*) AS frequency, CASE WHEN starts_with(feature, 'label:') THEN 100 WHEN starts_with(feature, 'category:') THEN 40
  ELSE 8 + least(48, (SELECT count(*) FROM part) * 20 // count(*)) END AS weight FROM e GROUP BY feature)"""


def _features(spark, sf):
    terms = F.transform(tx.title_terms(F.col("p_name")), lambda t: F.concat(F.lit("title:"), t))
    both = F.concat(F.array(F.concat(F.lit("label:"), "p_brand"), F.concat(F.lit("category:"), "p_type")), terms)
    return related.weighted_features(table(spark, sf, "part"), "p_partkey", both)


@query(_FEATURES + " SELECT feature, frequency, weight::BIGINT AS weight FROM w")
def feature_df(spark, sf):
    return _features(spark, sf).select("feature", "frequency", "weight").distinct()


@query(
    _FEATURES
    + """, f AS (SELECT e.p_partkey, feature, weight FROM e JOIN w USING (feature)),
    s AS (SELECT a.p_partkey, b.p_partkey AS candidate, sum(a.weight)::BIGINT AS score FROM f a JOIN f b USING (feature) WHERE a.p_partkey <> b.p_partkey GROUP BY ALL)
    SELECT p_partkey, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank <= 3"""
)
def top_candidates(spark, sf):
    return related.candidates(_features(spark, sf), "p_partkey", 3)


@query("SELECT source, lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL")
def storage_by_category(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query(
    """SELECT l_suppkey, loc, max(lastmod) AS lastmod FROM (SELECT l_suppkey, l_partkey AS loc, l_shipdate AS lastmod FROM lineitem
    UNION ALL SELECT l_suppkey, l_orderkey, l_shipdate FROM lineitem) GROUP BY ALL"""
)
def sitemap_union(spark, sf):
    lines = table(spark, sf, "lineitem")
    each = lines.select("l_suppkey", F.col("l_partkey").alias("loc"), F.col("l_shipdate").alias("lastmod")).union(
        lines.select("l_suppkey", F.col("l_orderkey"), "l_shipdate")
    )
    return each.groupBy("l_suppkey", "loc").agg(F.max("lastmod").alias("lastmod"))


@query(
    _FINGER.replace("WITH w", "WITH RECURSIVE w")
    + """, k AS (SELECT doc_id, 't:' || fingerprint AS key FROM f WHERE fingerprint IS NOT NULL
      UNION SELECT doc_id, 'o:' || lower(array_to_string(ws[1:12], ' ')) FROM f WHERE len(ws) >= 64),
    e AS (SELECT key, min(doc_id) AS x FROM k GROUP BY key), pairs AS (SELECT doc_id AS a, x AS b FROM k JOIN e USING (key) WHERE doc_id <> x),
    ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM r JOIN ways ON a = r.doc_id)
    SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id"""
)
def identity_components(spark, sf):
    """Documents are one article by an equal text or an equal opening, also
    through others."""
    docs = table(spark, sf, "documents")
    opening = F.when(F.size(tx.words(F.col("text"))) >= 64, F.concat(F.lit("o:"), F.lower(F.array_join(F.slice(tx.words(F.col("text")), 1, 12), " "))))
    return identity.components(docs, "doc_id", F.array(F.concat(F.lit("t:"), tx.fingerprint(F.col("text"))), opening))


_STEM = """SELECT *, strftime(o_orderdate, '%Y-%m-%d') || '-' || CASE WHEN s = '' THEN 'item' ELSE s END AS stem,
    'items/' || lower(o_orderstatus) || '/' || strftime(o_orderdate, '%Y/%m') AS folder
  FROM (SELECT *, trim(regexp_replace(lower(o_orderpriority || ' order with a rather long title that is cut at one of its words ' || o_orderstatus), '[^a-z0-9]+', '-', 'g'), '-') AS whole,
    CASE WHEN length(whole) <= 60 THEN whole ELSE regexp_extract(whole[1:60], '^(.*)-', 1) END AS s FROM orders)"""


@query(
    f"""WITH t AS ({_STEM}), n AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY o_orderkey) AS nth, sha1(o_orderkey::VARCHAR) AS d FROM t),
    named AS (SELECT o_orderkey, folder, CASE WHEN nth = 1 THEN stem ELSE stem || '-' || d[1:8] END AS name FROM n)
    SELECT o_orderkey, folder, name, 'items/' || split_part(folder, '/', 2) || '/' || name || '/' AS page,
      'urn:item:' || sha1(folder || '/' || name) AS urn FROM named"""
)
def item_paths(spark, sf):
    title = F.concat(F.col("o_orderpriority"), F.lit(" order with a rather long title that is cut at one of its words "), F.col("o_orderstatus"))
    orders = table(spark, sf, "orders").withColumns(
        {"stem": paths.file_stem(F.col("o_orderdate"), title), "folder": paths.item_folder(F.lower("o_orderstatus"), F.col("o_orderdate"))}
    )
    named = paths.unique_stems(orders, "folder", "stem", "o_orderkey", [F.asc("o_orderkey")])
    path = F.concat_ws("/", "folder", "name")
    return named.select("o_orderkey", "folder", "name", paths.item_page(path).alias("page"), F.concat(F.lit("urn:item:"), F.sha1(path)).alias("urn"))


@query(
    """SELECT event_id, (36 * 168) // (168 + date_diff('second', ts, newest) // 3600) AS bonus
    FROM events, (SELECT max(ts) AS newest FROM events)"""
)
def recency_bonuses(spark, sf):
    events = table(spark, sf, "events")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    return events.crossJoin(F.broadcast(newest)).select("event_id", paths.recency_bonus(F.col("newest"), F.col("ts")).alias("bonus"))
