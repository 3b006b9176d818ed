"""Recommendations against a sequential version that goes through the items."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from loomarc.operators import recommend
from loomarc.operators.recommend import Recommending

SCHEMA = "name string, date timestamp, source string, identity string, features array<string>"
NEWEST = datetime(2024, 5, 1, 12)


def sequential(rows, rule):
    items = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    frequency = Counter(f for r in items for f in set(r[4]))

    def weight(f):
        return 100 if f.startswith("label:") else 40 if f.startswith("category:") else 8 + min(48, 20 * len(items) // frequency[f])

    def beside(i, step):
        k = i + step
        while 0 <= k < len(items) and items[k][3] == items[i][3]:
            k += step
        return k if 0 <= k < len(items) else None

    taken, out = {i: set() for i in range(len(items))}, {}
    for i, (name, _, source, identity, features) in enumerate(items):
        sides = [beside(i, -1), beside(i, 1)]
        apart = {identity} | {items[k][3] for k in sides if k is not None}
        scores = {}
        for k, other in enumerate(items):
            if other[3] == identity:
                continue
            shared = set(features) & set(other[4])
            if shared or k < rule.pool:
                scores[k] = sum(map(weight, shared))
            if k < rule.pool:
                hours = int((items[0][1] - other[1]).total_seconds() // 3600)
                scores[k] += 36 * 168 // (168 + hours) + (rule.other_source if other[2] != source else 0)
        picked = []

        def fits(k, reciprocal, apart=apart, picked=picked, i=i):
            return items[k][3] not in apart and all(items[k][3] != items[p][3] for p in picked) and (reciprocal or k not in taken[i])

        for k in sorted(scores, key=lambda k: (-scores[k], k)):
            if len(picked) < rule.picks and fits(k, False):
                picked.append(k)
        for reciprocal in (False, True):
            for others in (True, False):
                for k in range(len(items)):
                    if len(picked) < rule.picks and (items[k][2] != source) == others and fits(k, reciprocal):
                        picked.append(k)
        for k in picked:
            taken[k].add(i)
        out[name] = (*[None if k is None else items[k][0] for k in sides], [items[k][0] for k in picked])
    return out


def archive(seed, n, labels, copies, sources, days):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        features = [f"label:{rng.randrange(labels)}" for _ in range(rng.randint(0, 2))] + [f"category:{rng.randrange(3)}"]
        features += [f"title:{rng.choice('abcdefghijklmnop')}" for _ in range(rng.randint(0, 4))]
        date = NEWEST - timedelta(hours=6 * rng.randrange(4 * days))  # with ties
        rows.append((f"n{k:03}", date, f"s{rng.randrange(sources)}", f"i{rng.randrange(max(1, n // copies))}", features))
    return rows


SMALL = Recommending(pool=4, keep=3, copies=1, front=3, common=3, listed=2)


@pytest.mark.parametrize(("seed", "rule", "shape"), [
    (2, SMALL, (40, 2, 3, 2, 3)),
    (4, Recommending(pool=2, common=5, listed=3), (70, 3, 1, 3, 2)),
])
def test_like_one_item_after_another(spark, seed, rule, shape):
    rows = archive(seed, *shape)
    want = sequential(rows, rule)
    found, rounds = recommend.recommend(spark.createDataFrame(rows, SCHEMA).repartition(3), rule)
    assert {r.name: (r.previous, r.next, r.recommended) for r in found.collect()} == want
    assert rounds >= 2 and any(a for *_, a in want.values())


def test_no_item_is_sent_back_to_one_that_suggests_it(spark):
    """Two items share a label of their own; the newer one keeps the other."""
    rows = [(f"n{k:02}", NEWEST - timedelta(hours=k), f"s{k}", f"i{k}", [f"label:{'x' if k in (1, 6) else k}", f"category:{k}"]) for k in range(20)]
    found = {r.name: r.recommended for r in recommend.recommend(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert "n06" in found["n01"] and "n01" not in found["n06"]
    assert all(len(set(a)) == 3 and name not in found[other] for name, a in found.items() for other in a)


def test_few_items(spark):
    rows = [("a", NEWEST, "s", "i", ["label:x"]), ("b", NEWEST, "t", "i", ["label:x"]), ("c", NEWEST, None, "j", None)]
    found, _ = recommend.recommend(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect())) == [("a", None, "c", []), ("b", None, "c", []), ("c", "b", None, [])]
    assert recommend.recommend(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_common_features_do_not_bring_all_pairs_together(spark):
    """All 400 items share seven features of eight, with copies among them; the
    best are found, ten copies of one article too, without meeting all pairs."""
    rows = [(f"n{k:03}", NEWEST - timedelta(hours=k % 90), "s", f"i{k % 40}", [f"title:{f}" for f in range(8) if f != k % 9]) for k in range(400)]
    rule = Recommending(pool=1, keep=12, copies=12, common=20)
    items = spark.createDataFrame(rows, SCHEMA)
    frequency = Counter(f for r in rows for f in r[4])
    weight = {f: 8 + min(48, 20 * len(rows) // n) for f, n in frequency.items()}
    want = {}
    for name, _, _, identity, features in rows:
        scores = [(-sum(weight[f] for f in set(features) & set(r[4])) - (36 if r[0] == "n000" else 0), -r[1].timestamp(), r[0]) for r in rows if r[3] != identity]
        want[name] = [c for *_, c in sorted(scores)[:12]]
    got = {}
    for r in sorted(recommend.ranked(items, rule).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.name, []).append(r.candidate)
    assert got == want
    assert recommend._met(recommend._described(items, rule), rule).count() < 400 * 400 / 4


def test_only_what_may_change_is_done_again(spark, monkeypatch):
    """Items choose again only if others refuse them or their list was too
    short, and only such lists are made longer."""
    rows = archive(7, 60, 4, 1, 3, 3)
    chosen, found = [], recommend._choices
    monkeypatch.setattr(recommend, "_choices", lambda lists, *rest: chosen.append(lists.count()) or found(lists, *rest))
    got, rounds = recommend.recommend(spark.createDataFrame(rows, SCHEMA), SMALL)
    assert {r.name: (r.previous, r.next, r.recommended) for r in got.collect()} == sequential(rows, SMALL)
    assert len(chosen) == rounds and chosen[0] == len(rows) and all(0 < n < len(rows) for n in chosen[1:])
