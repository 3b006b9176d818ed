"""Links as seen from a page, and the articles and feeds that pages name."""

import datetime as dt
from urllib.parse import urljoin

from pyspark.sql import functions as F

from loomarc.functions import urls
from loomarc.sources import pages


def test_joined(spark):
    bases = ["https://a.example/b/c/d?q=1#f", "http://a.example", "https://a.example/x"]
    links = ["g", "./g", "g/", "/g", "//h.example/p", "?y=2", "#s", "g?y#s", "../g", "../../../g", "..", ".", "g/./h/../i", "mailto:x@y", "https://z.example/../q", ""]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "base string, link string")
    for r in rows.select("base", "link", urls.joined(F.col("base"), F.col("link")).alias("found")).collect():
        want = urljoin(r.base, r.link)
        want = want.replace("a.example?", "a.example/?").replace("a.example#", "a.example/#")
        same = r.link == "" and r.found == r.base.split("#")[0] or r.found in (want, want + "/") and r.found.rstrip("/") == want.rstrip("/")
        assert same, (r.base, r.link, r.found, want)
    assert rows.select(urls.joined(F.lit("no base"), F.col("link"))).distinct().collect() == [(None,)]


PAGE = """<html><head><base href="/blog/"><!-- <link rel="alternate" type="application/rss+xml" href="no"> -->
<link rel="stylesheet" href="s.css"><link href='feed.xml' title="a > b" rel="Alternate home" type="application/RSS+xml; charset=utf-8"><link rel=feed type=application/feed+json href=/j?a=1&amp;b=2>
<link rel="alternate" type="text/html" href="x"><script>var a = '<a href="/rss">';</script></head>
<a href="/news/atom">n</a><a class="x" href="feed.xml">again</a><a href="all.RSS">r</a><a href="list?page=2&output=Atom">o</a><a href="ftp://f.example/feed">f</a><a href="about">about</a>
<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"P"},{"@type":["Thing","NewsArticle"],"headline":" One ","url":"/one","datePublished":"2024-03-04T05:06:07Z",
 "hasPart":{"@type":"Article","name":"Inner","mainEntityOfPage":{"@id":"inner"}}},{"@type":"Article","headline":"No link"},{"@type":"Article","headline":7,"url":"/seven"}]}</script>
<script type='application/ld+json'>{broken</script><script type=application/ld+json>[[{"@type":"BlogPosting","headline":"Deep","mainEntityOfPage":"https://o.example/deep","description":"d"}]]</script>
<h2><a href="two">Two <i>words</i></a></h2><a href="https://www.p.example/one#c"><div><h3>One again</h3></div></a><h2><a href="x">ab</a></h2><h1><a href="/start?utm_source=z">The page itself</a></h1></html>"""


def test_feed_links(spark):
    rows = spark.createDataFrame([(1, "https://p.example/start", PAGE), (2, "https://p.example/", "".join(f'<a href="/{k}/feed">' for k in range(30))), (3, "https://p.example/", None)], "id long, url string, html string")
    got = {r.id: r.found for r in rows.select("id", pages.feed_links(F.col("html"), F.col("url")).alias("found")).collect()}
    own = "https://p.example"
    assert got[1] == [f"{own}/blog/feed.xml", f"{own}/j?a=1&b=2", f"{own}/news/atom", f"{own}/blog/all.RSS", f"{own}/blog/list?page=2&output=Atom"]
    assert got[2] == [f"{own}/{k}/feed" for k in range(16)] and not got[3]


def test_page_articles(spark):
    rows = spark.createDataFrame([(1, "https://p.example/start", PAGE), (2, "https://p.example/", "<p>none"), (3, None, None)], "id long, url string, html string")
    got = pages.page_articles(rows, "id", "url", "html").orderBy("id", "position").collect()
    assert [(r.id, r.position, r.title, r.link) for r in got] == [
        (1, 0, "One", "https://p.example/one"),
        (1, 1, "Inner", "https://p.example/inner"),
        (1, 2, "Deep", "https://o.example/deep"),
        (1, 3, "Two words", "https://p.example/blog/two"),
    ]
    assert got[0].published.replace(tzinfo=None) == dt.datetime(2024, 3, 4, 5, 6, 7) and got[2].summary == "d"
    assert pages.page_articles(rows.limit(0), "id", "url", "html").count() == 0


def test_feed_links_clean_a_page_once(spark):
    """Comments and scripts are taken out of a page once, not for each link."""
    found = spark.range(1).select(F.concat(F.lit("<base href='/x/'><a href='rss'>"), F.col("id").cast("string")).alias("html"), F.lit("https://a.b/").alias("url"))
    plan = found.select(pages.feed_links(F.col("html"), F.col("url")).alias("f"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 1
    assert plan.first().f == ["https://a.b/x/rss"]
