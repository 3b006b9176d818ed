"""Articles and feeds that web pages name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..session import written
from .feeds import feed_time

#: Media types and names of feeds, and types of articles (fixed values).
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json")
FEED_NAMES = ("feed", "rss", "atom", "feed.xml", "rss.xml", "atom.xml", "index.xml", "feed.atom", "feed.json")
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")

MOST_FEEDS = 16


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; null without one."""
    shape = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, shape, n) for n in (1, 2, 3)])
    return F.when(tag.rlike(shape), F.replace(F.trim(value), F.lit("&amp;"), F.lit("&")))


def tags(html: Column, *names: str) -> Column:
    """The start tags of these elements, without comments and scripts."""
    return _tags(_bare(html), *names)


def _tags(bare: Column, *names: str) -> Column:
    return F.regexp_extract_all(bare, F.lit(rf"(?is)(<(?:{'|'.join(names)})\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))


def _bare(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")


def _base(html: Column) -> Column:
    return attribute(F.get(tags(html, "base"), F.lit(0)), "href")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def feed_links(html: Column, page: Column) -> Column:
    """Addresses of feeds: those advertised in ``link`` tags, then links whose
    last name or parameters say feed; each once, the first sixteen."""
    told = lambda bare: F.coalesce(urls.joined(page, attribute(F.get(_tags(bare, "base"), F.lit(0)), "href")), page)
    return _once(_bare(html), lambda bare: _once(told(bare), lambda base: _feeds(bare, base)))


def _feeds(bare: Column, base: Column) -> Column:
    web = r"(?i)^https?://"
    address = lambda tag: _once(attribute(tag, "href"), lambda href: urls.joined(base, href))
    kind = lambda tag: F.lower(F.trim(F.substring_index(F.coalesce(attribute(tag, "type"), F.lit("")), ";", 1)))
    rels = lambda tag: F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), r"\s+")
    told = F.filter(_tags(bare, "link"), lambda t: F.arrays_overlap(rels(t), F.array(F.lit("alternate"), F.lit("feed"))) & kind(t).isin(*FEED_TYPES))
    name = lambda u: F.lower(F.regexp_extract(u, r"^[^?#]*/([^/?#]*)", 1))
    asked = r"(?i)^[^?#]*\?(?:[^#]*&)?(?:format|output)=(?:rss|atom|feed)(?:[&#]|$)"
    looks = lambda u: name(u).isin(*FEED_NAMES) | name(u).rlike(r"\.(rss|atom)$") | u.rlike(asked)
    found = F.concat(F.transform(told, address), F.filter(F.transform(_tags(bare, "a"), address), looks))
    return F.slice(F.array_distinct(F.filter(found, lambda u: u.rlike(web))), 1, MOST_FEEDS)


def _said(path: str) -> Column:
    """Text at a path of the variant ``value``; null for other kinds and blanks."""
    kind = F.expr(f"schema_of_variant(try_variant_get(value, \"{path}\", 'variant'))")
    return F.nullif(F.trim(F.when(kind == "STRING", F.expr(f"try_variant_get(value, \"{path}\", 'string')"))), F.lit(""))


def json_ld_articles(pages: DataFrame, name: str, page: str, html: str) -> DataFrame:
    """(name, path, title, summary, link, published, updated) of the articles
    that the JSON-LD of pages describes, at any depth.

    Values are taken apart level by level, all pages together, in as many
    rounds as the deepest is deep.  ``path`` tells the place: in the order of
    a page's scripts, an object before what it holds, names in their order.  A
    block that is no JSON, and an article without a title or a web address,
    is left out.
    """
    spark = pages.sparkSession
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"), F.lit(1))
    nodes = pages.select(name, F.col(page).alias("_page"), F.posexplode(blocks).alias("at", "block"))
    nodes = nodes.select(name, "_page", F.array("at").alias("path"), F.try_parse_json("block").alias("value")).where("value is not null")
    found = None
    while True:
        nodes = written(nodes, "nodes")
        if found is not None and nodes.isEmpty():
            break
        kinds = F.coalesce(F.expr("try_variant_get(value, \"$['@type']\", 'array<string>')"), F.array(_said("$['@type']")))
        title = F.coalesce(_said("$.headline"), _said("$.name"))
        href = F.coalesce(_said("$.url"), _said("$.mainEntityOfPage"), _said("$.mainEntityOfPage['@id']"), _said("$.mainEntityOfPage.url"))
        said = {"title": title, "_href": href, "_published": _said("$.datePublished"), "_updated": _said("$.dateModified"), "summary": _said("$.description")}
        level = nodes.where(F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ARTICLE_TYPES])))
        level = level.select(name, "_page", "path", *[value.alias(c) for c, value in said.items()]).where("title is not null and _href is not null")
        found = level if found is None else found.union(level)
        inner = nodes.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("pos"), F.col("value").alias("inner")))
        inner = inner.where("schema_of_variant(inner) like 'ARRAY%' or schema_of_variant(inner) like 'OBJECT%'")
        nodes = inner.select(name, "_page", F.array_append("path", F.col("pos")).alias("path"), F.col("inner").alias("value"))
    # The next steps read each column many times, so they are written, not repeated.
    found = written(found, "articles")
    times = {"published": feed_time(F.col("_published")), "updated": feed_time(F.col("_updated"))}
    found = found.withColumns({"link": urls.joined(F.col("_page"), F.col("_href")), **times}).drop("_page", "_href", "_published", "_updated")
    return found.where(F.col("link").rlike("(?i)^https?://"))


def heading_articles(pages: DataFrame, name: str, page: str, html: str) -> DataFrame:
    """(name, path, title, link) of headings that hold one link or stand in
    one; the page itself and titles below three bytes are left out."""
    inside = r"(?is)<(h[1-6])\b[^>]*>\s*<a\s[^>]*>(?:(?!</a).)*</a\s*>\s*</\1\s*>|<a\s[^>]*>(?:(?!</a).)*?<(h[1-6])\b[^>]*>(?:(?!</a).)*</a\s*>"
    cards = F.posexplode(F.regexp_extract_all(_bare(F.col(html)), F.lit(inside), F.lit(0))).alias("at", "card")
    cards = pages.select(name, F.col(page).alias("_page"), _base(F.col(html)).alias("_told"), cards)
    heading = F.regexp_extract("card", r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1\s*>", 2)
    href = attribute(F.regexp_extract("card", r"(?is)(<a\s[^>]*>)", 1), "href")
    # Each step reads the columns of the one before many times, so they are written, not repeated.
    cards = written(cards.select(name, "_page", "_told", F.array("at").alias("path"), tx.html_text(heading).alias("title"), href.alias("_href")), "cards")
    cards = cards.withColumn("_base", F.coalesce(urls.joined(F.col("_page"), F.col("_told")), F.col("_page")))
    cards = written(cards.withColumn("link", urls.joined(F.col("_base"), F.col("_href"))).drop("_base", "_told", "_href"), "cards")
    own = urls.canonical_link(F.col("link")) == urls.canonical_link(F.col("_page"))
    return cards.where((F.octet_length("title") >= 3) & F.col("link").rlike("(?i)^https?://") & ~own).drop("_page")


def page_articles(pages: DataFrame, name: str, page: str, html: str) -> DataFrame:
    """The articles a page names: those of its JSON-LD, then its headings, each
    link once, as first seen: name, position, title, link, published, updated,
    summary."""
    data = json_ld_articles(pages, name, page, html).withColumn("kind", F.lit(0))
    cards = heading_articles(pages, name, page, html).withColumn("kind", F.lit(1))
    both = written(data.unionByName(cards, allowMissingColumns=True), "articles").withColumn("_link", urls.canonical_link(F.col("link")))
    first = both.withColumn("_nth", F.row_number().over(Window.partitionBy(name, "_link").orderBy("kind", "path"))).where("_nth = 1")
    place = (F.row_number().over(Window.partitionBy(name).orderBy("kind", "path")) - 1).alias("position")
    return first.select(name, place, "title", "link", "published", "updated", "summary")
