"""Articles and feeds that pages name, on pages with parts made from their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages
from .registry import query, table

_HEAD = '<link rel="alternate" type="application/atom+xml" href="feeds/{0}.atom"><link rel="stylesheet" href="/feed"><a href="/rss">all</a>'
_DATA = (
    '<script type="application/ld+json">{{"@graph":[{{"@type":"WebSite","name":"Site"}},{{"@type":["Thing","NewsArticle"],"headline":"Part {0}","url":"/a/{0}","hasPart":['
    '{{"@type":"BlogPosting","name":"Deep {0}","mainEntityOfPage":{{"@id":"https://deep.example/{0}"}}}},{{"@type":"Article","headline":"Again","url":"/a/{0}#x"}}]}}]}}</script>'
)
_CARD = '<h2><a href="../card-{0}">Card {0}</a></h2>'


def _pages(spark, sf):
    made = F.format_string((_HEAD + _DATA + _CARD).format("%1$s"), "page_id")
    html = F.concat(F.lit("<html>"), made, F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


_PLACES = """(SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host,
  coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') AS folder FROM pages)"""


@query(f"SELECT page_id, unnest([host || folder || 'feeds/' || page_id || '.atom', host || '/rss']) AS feed, unnest([0, 1]) AS position FROM {_PLACES}")
def feed_links(spark, sf):
    found = _pages(spark, sf).select("page_id", F.posexplode(pages.feed_links(F.col("html"), F.col("url"))).alias("position", "feed"))
    return found.select("page_id", "feed", "position")


@query(
    f"""SELECT page_id, unnest([0, 1, 2]) AS position, unnest(['Part ' || page_id, 'Deep ' || page_id, 'Card ' || page_id]) AS title,
    unnest([host || '/a/' || page_id, 'https://deep.example/' || page_id, host || regexp_replace(folder, '[^/]+/$', '') || 'card-' || page_id]) AS link FROM {_PLACES}"""
)
def page_articles(spark, sf):
    return pages.page_articles(_pages(spark, sf), "page_id", "url", "html").select("page_id", "position", "title", "link")
