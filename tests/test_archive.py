"""Edge cases of the archive operators, as literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomarc.functions import dates, text, urls
from loomarc.operators import archive, search, state
from loomarc.plans import registry
from loomarc.sources import archive_items, rss_items, source_list
from loomarc.streaming import append_batches


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_canonical_link(spark):
    links = {
        "http://www.Example.com/a/?b=2&a=1&utm_x=3#f": "https://example.com/a?a=1&b=2",
        "http://example.com:8080/": "http://example.com:8080/",
        "https://example.com:443": "https://example.com/",
        " not a link ": "not a link",
    }
    assert one(spark, [(k,) for k in links], "u string", urls.canonical_link(F.col("u"))) == list(links.values())


def test_durations_and_sizes(spark):
    given = {"PT1H2M3.5S": 3724, "1:02:03": 3723, "90.0": 90, "0": None, "x": None, "1:75": None}
    assert one(spark, [(k,) for k in given], "u string", text.duration_seconds(F.col("u"))) == list(given.values())
    sizes = {"2k": 2000, "1.5 MiB": 1572864, "7": 7, "2.": None, "1.1234567k": None}
    assert one(spark, [(k,) for k in sizes], "u string", text.byte_size(F.col("u"))) == list(sizes.values())


def test_excerpt_cuts_at_a_word(spark):
    assert one(spark, [("aa bb cc",), ("short",)], "t string", text.excerpt(F.col("t"), 6)) == ["aa bb…", "short"]


def test_retention_ties_and_inclusive_cutoff(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("s", day(1), "a", 5), ("s", day(2), "b", 5), ("s", day(2), "c", 5), ("s", day(3), "d", 5)]
    items = spark.createDataFrame(rows, "source string, at timestamp_ntz, path string, size long")
    out = archive.retention(items, "source", "at", "path", "size", F.lit("2024-01-02").cast("timestamp_ntz"), F.lit(0), F.lit(10))
    assert {r.path: r.reason for r in out.collect()} == {"a": "age", "b": None, "c": "bytes", "d": None}


def test_neighbours_skip_the_same_identity(spark):
    rows = [("x", k, i) for k, i in enumerate("AABBC")]
    items = spark.createDataFrame(rows, "g string, n int, i string")
    out = archive.neighbours(items, [F.asc("n")], "n", "i", "g").orderBy("n").collect()
    assert [(r.previous, r.next) for r in out] == [(None, 2), (None, 2), (1, 4), (1, 4), (3, None)]


def test_status_keeps_the_first_error(spark):
    before = spark.createDataFrame([("a", "old", "t0"), ("b", "old", "t0"), ("d", "old", "t0")], "source string, message string, since string")
    outcome = spark.createDataFrame([("a", "new"), ("b", ""), ("c", "new")], "source string, error string")
    got = {r.source: (r.message, r.since) for r in state.status(before, outcome, F.lit("t1")).collect()}
    assert got == {"a": ("old", "t0"), "c": ("new", "t1"), "d": ("old", "t0")}


def test_query_language(spark):
    q = search.parse('plain "two words" -gone lang:en -source:x date:2024-01-01..2024-02-01 sort:oldest')
    assert (q.words, q.phrases, q.without, q.facets, q.sort) == (["plain"], [["two", "words"]], [["gone"]], {"lang": ["en"]}, "oldest")
    for wrong in ('"open', "date:2024-02-01..2024-01-01", "sort:best", "a " * 17):
        with pytest.raises(search.QueryError):
            search.parse(wrong)
    docs = spark.createDataFrame([(1, "Go, go on"), (2, "on go"), (3, "")], "doc_id long, text string")
    assert [r[0] for r in search.search(docs, search.parse('"go on"')).select("doc_id").collect()] == [1]


def test_backoff(spark):
    assert one(spark, [(0,), (1,), (3,), (60,)], "n int", dates.retry_minutes(F.col("n"))) == [0, 30, 120, 10080]


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# all\nhttps://a.example/ # one\n\nhttps://b.example/\n")
    assert source_list(spark, str(tmp_path / "list.txt")).count() == 2
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>T</title><link>https://a.example/1</link><guid>g1</guid>"
        "<pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    )
    row = rss_items(spark, str(tmp_path / "feed.xml")).first()
    assert (row.id, row.title) == ("g1", "T") and row.published is not None
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x.md").write_text("---\ntitle: T\n---\nbody")
    assert archive_items(spark, str(tmp_path / "i")).first().body == "body"


def test_stream_appends_whole_batches(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    append_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_every_query_has_sql():
    # SQL has no form for choices that depend on choices; they are tested against going row by row.
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"recommendations", "admitted_pictures", "ingest_plan"}
