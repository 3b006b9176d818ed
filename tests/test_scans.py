"""Running sums, groups cut by limits, and budgets, against going row by row."""

import random

import pytest
from pyspark.sql import functions as F

from loomarc.operators import archive, budget, cuts, scans
from loomarc.operators.cuts import Limits


@pytest.fixture
def many_ranges(spark):
    """Several ranges even of few rows."""
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("false", "5"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def test_scans(many_ranges):
    rng = random.Random(1)
    rows = [(k, rng.choice((None, 1, 5)), rng.choice((None, None, None, k))) for k in rng.sample(range(1000), 80)]
    items = many_ranges.createDataFrame(rows, "k long, n long, v long")
    rows.sort()
    got = {r.k: r.total for r in scans.running(items, ["k"], {"total": F.col("n")}).collect()}
    assert got == {k: sum(n or 0 for _, n, _ in rows[: i + 1]) for i, (k, _, _) in enumerate(rows)}
    for after in (True, False):
        got = {r.k: r.w for r in scans.nearest(items, ["k"], F.col("v"), "w", after).collect()}
        for i, (k, _, _) in enumerate(rows):
            values = [v for _, _, v in (rows[i:] if after else rows[: i + 1]) if v is not None]
            assert got[k] == (values[0 if after else -1] if values else None)
    assert scans.running(items.limit(0), ["k"], {"total": F.col("n")}).count() == 0


def groups(rows, limits):
    """(key, time, id, size) rows -> {id: group}, one row after another."""
    found, state = {}, {}
    for key, time, name, size in sorted(rows):
        first, n, total, group = state.get(key, (None, 0, 0, -1))
        over = n == 0 or (limits.rows and n == limits.rows) or (limits.sums and total + size > limits.sums["size"]) or (limits.distance and time - first >= limits.distance)
        first, n, total, group = (time, 1, size, group + 1) if over else (first, n + 1, total + size, group)
        found[name], state[key] = group, (first, n, total, group)
    return found


@pytest.mark.parametrize("limits", [Limits(sums={"size": 400}, distance=300), Limits(5, {"size": 60}, 40)])
def test_cuts(many_ranges, limits):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaab"), rng.randrange(900), k, rng.randint(1, 99)) for k in range(150)] + [("c", 4, 999, 400), ("c", 5, 1000, 1), ("d", 1, 1001, 9), ("d", 2, 1002, 9), ("d", 3, 1003, 9)]
    items = many_ranges.createDataFrame(rows, "key string, time long, name long, size long")
    got = {r.name: r.group for r in cuts.cut(items, ["key"], ["time", "name"], limits).collect()}
    assert got == groups(rows, limits)


def test_cuts_without_a_key_or_rows(many_ranges):
    rows = [("", k, k, 1 + k % 13) for k in range(200)]
    items = many_ranges.createDataFrame(rows, "key string, time long, name long, size long").withColumn("extra", F.lit("x"))
    found = cuts.cut(items, [], ["time"], Limits(20, {"size": 100}))
    assert {r.name: r.group for r in found.collect()} == groups(rows, Limits(20, {"size": 100})) and "extra" in found.columns
    assert cuts.cut(items.limit(0), [], ["time"], Limits(rows=3)).count() == 0
    with pytest.raises(ValueError, match="limit"):
        cuts.cut(items, [], ["time"], Limits())


def one_by_one(families, limit):
    paid, used, found = set(), 0, {}
    for name, _, parts in sorted(families, key=lambda f: f[1]):
        new = {p: b for p, b in parts or [] if p not in paid}
        fits = sum(new.values()) <= limit - used
        if fits:
            used += sum(new.values())
            paid |= set(new)
        found[name] = (fits, sum(new.values()) if fits else None)
    return found


@pytest.mark.parametrize(("seed", "paths", "limit"), [(1, 10_000, 700), (2, 40, 900)])
def test_admission(many_ranges, seed, paths, limit):
    rng = random.Random(seed)
    weights = {p: rng.choice((1, 5, 30, 200)) for p in range(paths)}
    families = []
    for k in range(90):
        own = [rng.randrange(paths) for _ in range(rng.randint(0, 4))]
        families.append((f"f{k}", rng.random(), [(f"p{p}", weights[p]) for p in own]))
    families += [("none", 2.0, None), ("twice", 2.1, [("x", 1), ("x", 3)])]
    frame = many_ranges.createDataFrame(families, "name string, at double, parts array<struct<path:string,bytes:long>>")
    found, rounds = budget.admitted(frame, "name", ["at"], F.col("parts"), limit)
    assert {r.name: (r.admitted, r.cost) for r in found.collect()} == one_by_one(families, limit)
    assert rounds < 30


def test_families_that_share_parts(many_ranges):
    """A family that does not fit goes whole; a shared part is paid for once."""
    rows = [("a", 1, [("master", 6), ("small", 2)]), ("b", 2, [("master", 6), ("other", 2)]), ("c", 3, [("big", 3)]), ("d", 4, [("small", 2)])]
    frame = many_ranges.createDataFrame(rows, "name string, at long, parts array<struct<path:string,bytes:long>>")
    found, _ = budget.admitted(frame, "name", ["at"], F.col("parts"), 10)
    assert {r.name: r.cost for r in found.collect()} == {"a": 8, "b": 2, "c": None, "d": 0}
    assert budget.admitted(frame.limit(0), "name", ["at"], F.col("parts"), 10)[0].count() == 0


def test_numbered_with_many_rows_a_range(many_ranges):
    """Bounds of ranges are drawn from a sample, once for places and sizes."""
    for wide in ("true", "false"):
        many_ranges.conf.set("spark.sql.adaptive.enabled", wide)
        items = many_ranges.range(0, 60_000, 1, 12).select(F.sha1(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 200).alias("more"))
        keyed = items.groupBy("k").agg(F.max("more").alias("more"))
        got = archive.numbered(keyed, "k").collect()
        assert [r.k for r in sorted(got, key=lambda r: r.nth)] == sorted(r.k for r in got)
        assert sorted(r.nth for r in got) == list(range(60_000))


def test_sitemap_entries_are_not_stored_while_files_are_cut(spark):
    from loomarc import sinks

    urls = spark.createDataFrame([(f"https://a.b/{k:02}", f"2024-01-{k + 1:02}") for k in range(20)], "loc string, day string").selectExpr("loc", "timestamp(day) as modified")
    found = sinks.sitemap_files(urls, "loc", "modified", 8)
    assert all("entry" not in spark.read.parquet(f).columns for f in found.inputFiles())
    rows = found.collect()
    assert sorted({(r.file, r.urls) for r in rows}) == [(1, 8), (2, 8), (3, 4)]
    for n in (1, 2, 3):
        inside = sum(len(r.entry) for r in rows if r.file == n)
        assert {r.bytes for r in rows if r.file == n} == {inside + len(sinks.SITEMAP_HEAD + sinks.SITEMAP_TAIL)}


def test_parts_that_many_families_hold(many_ranges):
    """Once little is left, families that hold much go at once, however many
    share their parts; a part counts as what its cheapest family names."""
    families = [("first", 0, [("a", 90)])] + [(f"f{k:02}", k, [("b", 6), (f"c{k % 2}", 6)]) for k in range(1, 41)]
    families += [("cheap", 50, [("b", 2), ("c0", 7)]), ("paid", 51, [("a", 90)]), ("late", 52, [("b", 2)]), ("none", 53, None), ("small", 54, [("d", 1)])]
    frame = many_ranges.createDataFrame(families, "name string, at long, parts array<struct<path:string,bytes:long>>")
    few = [f for f in families if not 2 < f[1] < 41]
    found, _ = budget.admitted(frame.where("not at between 3 and 40"), "name", ["at"], F.col("parts"), 100)
    want = one_by_one(few, 100)
    assert {r.name: (r.admitted, r.cost) for r in found.collect()} == want and want["cheap"] == (True, 9)
    found, rounds = budget.admitted(frame.where("name not in ('cheap', 'late')"), "name", ["at"], F.col("parts"), 100)
    assert {r.name: r.cost for r in found.where("admitted").collect()} == {"first": 90, "paid": 0, "none": 0, "small": 1}
    assert rounds <= 4
