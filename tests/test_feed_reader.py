"""Feeds of all kinds, broken ones among them, as items."""

import datetime as dt

import pytest

from loomarc.sources import feeds

RSS = """﻿ <?xml version="1.0" encoding="utf-8"?>
<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>Show &amp; tell</title><link>/home</link><language>en-us</language>
<item><title>A &lt;b&gt;bold&lt;/b&gt; caf&eacute; & more</title><link>/a</link><guid isPermaLink="false">g1</guid><pubDate>Tue, 05 Mar 2024 10:00:00 +0200</pubDate>
 <author>mail@host (Ann B)</author><category> News </category><category/><description><![CDATA[<p>One & <i>two</i></p>]]></description></item>
<item><guid>g2</guid><enclosure url="/e.mp3" type="audio/mpeg" length="99"/><itunes:duration>1:02:03</itunes:duration><itunes:image href="e.png"/><dc:creator>Cy</dc:creator></item>
<item><title>No link at all</title></item>
<item><title>Film</title><link>https://www.youtube.com/watch?v=1</link><media:group><media:title/><media:description>First\n\nThen &lt;x&gt;</media:description><media:thumbnail url="https://i.example/t.jpg"/><media:content url="https://x.example/v" type="video/mp4" duration="75"/></media:group></item>
<item><title>Short</title><link>https://www.youtube.com/shorts/abc</link></item>
<item><title>Full</title><guid>https://x.example/full</guid><description>teaser</description><content:encoded><![CDATA[<h1>All</h1>]]></content:encoded></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de" xml:base="https://b.example/x/"><title type="html">A&amp;amp;B</title>
<link rel="self" href="feed.xml"/><link href="/"/>
<entry><id>urn:1</id><title>Eins</title><link rel="enclosure" type="audio/ogg" href="s.ogg" length="0"/><link rel="self" href="self"/><link rel="alternate" type="application/json" href="j"/><link rel="alternate" type="text/html" href="h"/>
 <updated>2024-02-01T00:30:00Z</updated><author><name>Di</name></author><category term="t" label="Label"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Body</p></div></content></entry>
<entry><id>urn:2</id><title/><link href="only"/><published>2024-01-31T23:00:00-02:00</published><updated>2024-02-02</updated><summary>  s  </summary><content>plain\n\n&lt;two&gt;\nlines</content></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel>
<item rdf:about="x"><title>Old</title><link>https://r.example/1</link><dc:date>2003-05-06T07:08:09Z</dc:date><dc:subject>s</dc:subject></item></rdf:RDF>"""
JSON = """{"version":"https://jsonfeed.org/version/1.1","title":"J","home_page_url":"https://j.example/","language":"fr","items":[
{"id":7,"url":"https://j.example/7","content_text":"a & b","tags":["x"," "],"image":"/p.png","authors":[{"name":"Ed"},{}],"date_published":"2024-05-06T07:08:09+02:00",
 "attachments":[{"url":"https://j.example/7.mp3","mime_type":"audio/mpeg","size_in_bytes":5,"duration_in_seconds":61}]},
{"id":"8"},"odd",{"id":"9","external_url":"https://o.example/9","title":"Nine","content_html":"<p>9</p>"}]}"""


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    files = {"rss.xml": RSS, "atom.xml": ATOM, "rdf.xml": RDF, "feed.json": JSON, "page.xml": "<html><body/></html>", "cut.xml": RSS[:900], "empty.xml": "", "other.json": "{}", "skip.txt": RSS}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    raw = feeds.raw_entries(spark, str(folder), base="https://base.example/f/feed", glob="*.{xml,json}")
    found = {}
    for r in feeds.feed_items(raw).orderBy("file", "position").collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    return found


def test_rss(items):
    a, b, film, full = items["rss.xml"]
    assert (a.title, a.link, a.id, a.feed_title, a.feed_language, a.feed_site) == ("A bold café & more", "https://base.example/a", "g1", "Show & tell", "en-US", "https://base.example/home")
    assert (a.published.replace(tzinfo=None), a.authors, a.labels, a.summary, a.content) == (dt.datetime(2024, 3, 5, 8), ["Ann B"], ["News"], "One & two", "<p>One & <i>two</i></p>")
    assert (b.title, b.link, b.duration_seconds, b.thumbnail, b.authors) == ("base.example", "https://base.example/e.mp3", 3723, "https://base.example/f/e.png", ["Cy"])
    assert tuple(b.audio) == ("https://base.example/e.mp3", "audio/mpeg", 99)
    assert (film.summary, film.content, film.duration_seconds, film.pictures) == ("First Then", "<p>First</p>\n<p>Then &lt;x&gt;</p>", 75, ["https://i.example/t.jpg"])
    assert (full.link, full.summary, full.content) == ("https://x.example/full", "teaser", "<h1>All</h1>")


def test_atom(items):
    a, b = items["atom.xml"]
    assert (a.link, a.feed_title, a.feed_site, a.feed_language) == ("https://b.example/x/h", "A&B", "https://b.example/", "de")
    assert tuple(a.audio) == ("https://b.example/x/s.ogg", "audio/ogg", None)
    assert (a.labels, a.authors, a.published.replace(tzinfo=None)) == (["Label"], ["Di"], dt.datetime(2024, 2, 1, 0, 30)) and "<p>Body</p>" in a.content
    assert (b.title, b.published.replace(tzinfo=None), b.updated.day, b.summary) == ("b.example", dt.datetime(2024, 2, 1, 1), 2, "s")
    assert b.content == "<p>plain</p>\n<p>&lt;two&gt;<br>lines</p>"


def test_rdf_and_json(items):
    (old,) = items["rdf.xml"]
    assert (old.link, old.published.year, old.labels) == ("https://r.example/1", 2003, ["s"])
    seven, nine = items["feed.json"]
    assert (seven.id, seven.title, seven.content, seven.labels, seven.authors) == ("7", "j.example", "<p>a &amp; b</p>", ["x"], ["Ed"])
    assert (seven.duration_seconds, tuple(seven.audio), seven.thumbnail) == (61, ("https://j.example/7.mp3", "audio/mpeg", 5), "https://base.example/p.png")
    assert (nine.link, nine.content, nine.feed_site) == ("https://o.example/9", "<p>9</p>", "https://j.example/")


def test_files_that_fail_are_rows(items):
    assert {name for name, rows in items.items() if [r.link for r in rows] == [None] and rows[0].error} == {"page.xml", "cut.xml", "other.json"}
    assert not {"skip.txt", "empty.xml"} & set(items)
