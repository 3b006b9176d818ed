"""Publishers of links by hand, and the query against its SQL."""

import duckdb
from pyspark.sql import functions as F

from loomarc.functions import publishers
from loomarc.plans import registry

NAMES = {
    "https://www.Some-Site.org./a/b": "some-site.org",
    "https://user:pw@site.org:8443/x": "site.org:8443",
    "http://site.org:80/x": "site.org",
    "https://github.com/someone/thing/issues": "github.com/someone",
    "https://github.com/Pricing": "github.com",
    "https://mobile.twitter.com/bob/status/9": "x.com/bob",
    "https://x.com/i/lists": "x.com",
    "https://np.reddit.com/user/bob/": "reddit.com/user/bob",
    "https://reddit.com/r": "reddit.com",
    "https://m.youtube.com/@bob/shorts": "youtube.com/@bob",
    "https://youtu.be/abc": "youtube.com",
    "https://vimeo.com/77": "vimeo.com",
    "https://vimeo.com/77a": "vimeo.com/77a",
    "https://fedi.example/@bob/3": "fedi.example/@bob",
    "https://fedi.example/@": "fedi.example",
    "https://codeberg.org/user/login": "codeberg.org",
    "https://gitlab.com/explore/groups": "gitlab.com",
    "https://gitlab.com/group/x": "gitlab.com/group",
    "https://medium.com/@me": "medium.com",
    "https://medium.com/@bob/story": "medium.com/@bob",
    "https://soundcloud.com/Discover": "soundcloud.com",
    "https://m.twitch.tv/videos/1": "twitch.tv",
    "https://vimeo.com/groups/x": "vimeo.com",
    "https://open.spotify.com/show/q": "spotify.com/show/q",
    "https://open.spotify.com/episode/q": "spotify.com",
    "mailto:bob@site.org": None,
    "ftp://github.com/bob": None,
    "": None,
    None: None,
}


def test_names(spark):
    rows = spark.createDataFrame([(k,) for k in NAMES], "link string")
    assert {r[0]: r[1] for r in rows.select("link", publishers.publisher(F.col("link"))).collect()} == NAMES
    more = publishers.account_path(F.col("link"), {"fedi.example": ("@bob",)})
    assert rows.where("link like '%@bob/3'").select(more).first()[0] is None


def test_channels(spark):
    links = ["https://youtube.com/feeds/videos.xml?user=b%20c&channel_id=X", "https://www.youtube.com/feeds/videos.xml/?channel_id=X#y", "https://youtube.com/@b", None]
    rows = spark.createDataFrame([(k,) for k in links], "link string").select(publishers.channel_path(F.col("link")), publishers.opaque(F.col("link")))
    assert [tuple(r) for r in rows.collect()] == [("/user/b c", False), ("/channel/X", False), (None, False), (None, False)]


def test_query_equals_sql(spark, tmp_path):
    urls = [(k, f"https://a{k % 3}.example/{'x' * (k % 2)}/{k}?p={k}#t" if k % 5 else "https://b.example") for k in range(60)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = "page_id, account, publisher, opaque, channel"
    wanted = duckdb.sql(f"SELECT {columns} FROM ({registry.oracle_sql()['publisher_names']}) ORDER BY 1").fetchall()
    got = registry.queries()["publisher_names"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).orderBy("page_id")
    assert [tuple(r) for r in got.collect()] == wanted
    assert len({r[2] for r in wanted}) > 10
