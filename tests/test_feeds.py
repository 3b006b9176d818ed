"""Edge cases of serialisers, text clean-up, dates and cache trimming."""

import datetime as dt

from pyspark.sql import functions as F

from loomarc import sinks
from loomarc.functions import dates, text
from loomarc.operators import state


def each(spark, given, expression):
    rows = spark.createDataFrame([(k,) for k in given], "t string")
    return [r[0] for r in rows.select(expression(F.col("t")).alias("x")).collect()]


def test_without_active(spark):
    given = {
        '<p onclick="x()" id=a>on x=1</p><script>1<2</script>': "<p id=a>on x=1</p>",
        "<a href='javascript:x'>y</a><embed src=z>": "<a>y</a>",
        "a > b onload=1 <!-- c --><b>": "a > b onload=1 <b>",
        "": "",
    }
    assert each(spark, given, text.without_active) == list(given.values())
    assert each(spark, [None], text.without_active) == [None]


def test_names_and_tags(spark):
    assert each(spark, ["Ab-c 1!", "..", None], text.identity_key) == ["abc1", None, None]
    assert each(spark, ["EN_us", "zh-hans-cn", "de", "e", "x y"], text.language_tag) == ["en-US", "zh-Hans-CN", "de", None, None]
    assert each(spark, ["a (1/3)", "b [2/3] ", "c 3/3", "1/2c", "d"], text.without_counter) == ["a", "b", "c", "1/2c", "d"]
    assert each(spark, ["A,b,a,B, ,c"], lambda t: text.first_spellings(F.split(t, ","))) == [["A", "b", "c"]]


def test_source_sets(spark):
    given = {"a.jpg 1x, b.jpg 2x": "b.jpg", "a,1.jpg 100w, b.jpg 100w": "b.jpg", "only.png": "only.png", "": None}
    assert each(spark, given, text.best_picture) == list(given.values())


def test_chapters(spark):
    [found] = each(spark, ["Intro\n0:00 Start\n(1:02:03) - End\n9:99 no"], text.chapters)
    assert [tuple(c) for c in found] == [("0:00", "Start"), ("1:02:03", "End")]


def test_written_dates(spark):
    given = {"2024-02-29": (2024, 2, 29), "March 3rd, 2024": (2024, 3, 3), "4 Jan 2024": (2024, 1, 4), "12/31/2024": (2024, 12, 31), "soon": None}
    assert each(spark, given, dates.written_date) == [v and dt.date(*v) for v in given.values()]


def test_relative_text_and_sweeps(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    at = lambda t: t.cast("timestamp_ntz")
    given = {"2024-02-01": "just now", "2024-01-30 23:58:00": "2m", "2024-01-29": "2d", "2023-11-01": "3mo", "2020-01-31": "4y", None: None}
    got = each(spark, given, lambda t: dates.relative_text(at(t), now))
    assert got[:5] == list(given.values())[:5]
    due = each(spark, [None, "2024-01-30 00:00:00", "2024-01-30 01:00:00", "2024-02-02"], lambda t: dates.sweep_due(at(t), now))
    assert due == [True, True, False, True]


def test_items(spark):
    none = F.lit(None).cast("timestamp_ntz")
    rss = lambda t: sinks.rss_item(F.lit("1"), F.lit("l"), t, F.lit(None).cast("string"), none)
    assert each(spark, ["a<&", None], rss) == ["<item><title>a&lt;&amp;</title><link>l</link><guid>1</guid></item>", "<item><link>l</link><guid>1</guid></item>"]
    when = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    [atom] = each(spark, ["t"], lambda t: sinks.atom_entry(F.lit("1"), F.lit("l"), t, t, when))
    assert "<updated>2024-01-02T03:04:05Z</updated>" in atom
    [item] = each(spark, ['say "x"'], lambda t: sinks.markdown_item({"title": t, "link": F.lit(None)}, F.lit("body")))
    assert item == '---\ntitle: "say \\"x\\""\n---\nbody'
    assert each(spark, ["n&m"], lambda t: sinks.outline(t, F.lit("f"))) == ['<outline type="rss" text="n&amp;m" xmlUrl="f"/>']


def test_collections_keep_the_first(spark):
    items = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 4, "w")], "g string, i int, t string")
    out = sinks.collections(items, "g", "i", [F.desc("i")], F.col("t"), F.lit("<"), F.lit(">"), 2)
    assert {r.g: (r["items"], r.body) for r in out.collect()} == {"a": (2, "<zy>"), "b": (1, "<w>")}


def test_trimmed_takes_the_oldest_until_the_rest_fits(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    rows = [("new", 5, day(3)), ("old", 5, day(1)), ("older", 5, None), ("tie", 5, day(1))]
    files = spark.createDataFrame(rows, "path string, size long, used timestamp_ntz")
    evicted = lambda limit: {r.path for r in state.trimmed(files, "size", "used", "path", limit).collect()}
    assert evicted(20) == set() and evicted(19) == {"older"} and evicted(10) == {"older", "old"} and evicted(0) == {"new", "old", "older", "tie"}
    assert state.trimmed(files.limit(0), "size", "used", "path", 1).count() == 0


def test_unique_matches_and_shared_values(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k string, a int")
    right = spark.createDataFrame([("k", 1), ("m", 4)], "k string, b int")
    assert [tuple(r) for r in state.unique_matches(left, right, ["k"]).collect()] == [("m", 3, 4)]
    pages = spark.createDataFrame([(n, "h", ["u", "u", f"v{n}"]) for n in range(3)], "n int, h string, l array<string>")
    assert [tuple(r) for r in state.shared_values(pages, "n", F.col("h"), F.col("l")).collect()] == [("h", "u", 3)]
