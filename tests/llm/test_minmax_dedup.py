"""Near duplicates by min-max hashing against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomarc.llm import minmax_dedup
from loomarc.llm.minmax_dedup import MinMaxDedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key long, set_id string"


def corpus():
    """Families around the threshold, chains, a shared passage, odd rows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(40)], []
    for _ in range(5):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            cut = rng.randint(0, 6)
            texts.append(copy[cut:] if rng.random() < 0.5 else copy + [word() for _ in range(cut)])
    texts += [[*passage, *[word() for _ in range(rng.randint(1, 12))]] for _ in range(40)]
    texts += [[word() for _ in range(n)] for n in range(12)] + [["a"] * 300, list("abcde") * 500, list("abcde") * 501]
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[3].replace(" ", "\n\t"), None, "", " \n\t", "x" * 300_000, " ".join(map(str, range(60_000))), " ".join(map(str, range(60_400)))]
    rows = [(k, t, k % 3, None) for k, t in enumerate(texts, 7)]
    return [*rows, rows[5], (1, texts[9], 0, "x")]


ROWS = corpus()


def brute_force(rows, over=85):
    sets = {}
    for k, t, *_ in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= over * max(len(x), len(y)) and 100 * len(x & y) >= over * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("rule", "parts"), [(MinMaxDedup(), 3), (MinMaxDedup(block_sets=7, block_shingles=900), 1)])
def test_groups(spark, rule, parts):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    found = brute_force(ROWS)
    got = minmax_dedup.near_duplicate_groups(docs, rule).collect()
    want = [(k, *found[k], found[k][1] == k) for k, *_ in ROWS]
    assert sorted(map(tuple, got)) == sorted(want)
    groups = {c for _, c in found.values()}
    assert 30 < len(groups) < len(found) - 60


def test_blocks_find_what_hubs_do_not(spark):
    """A ring: each text is like its neighbours only, and all share buckets."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100]), 0, "") for k in range(90)]
    got = minmax_dedup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), MinMaxDedup(block_sets=5)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: c for k, (_, c) in brute_force(rows).items()}


def test_rows_without_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f", 0, ""), (None, None, 0, ""), (4, "a b c d e f", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minmax_dedup.near_duplicate_groups(docs).collect()
    assert sorted(map(tuple, got), key=str) == [(4, 2, 4, True), (None, 0, None, True), (None, 2, 4, False)]
    assert minmax_dedup.near_duplicate_groups(docs.where(F.lit(False))).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    rule, agree = MinMaxDedup(bands=40), []
    for _ in range(60):
        both, own, its = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))
        tokens = np.concatenate([both, own, both, its])
        low, high = minmax_dedup.signatures(rule, tokens, np.array([0, 185]))
        agree.append(((low[0] == low[1]).mean() + (high[0] == high[1]).mean()) / 2)
    assert abs(np.mean(agree) - 170 / 200) < 0.01
    keys = minmax_dedup.band_keys(rule, low, high)
    assert keys.shape == (2, 40) and len(np.unique(keys[0])) == 40


def test_bitmaps_lose_no_similar_pair():
    rng = random.Random(6)
    rule, members, sets = MinMaxDedup(), [], {}
    base = [rng.randrange(1 << 62) for _ in range(140)]
    for k in range(120):
        own = {x for x in base if rng.random() > 0.12} | {rng.randrange(1 << 62) for _ in range(rng.randint(0, 30))}
        sets[k] = own
        members.append((k, len(own), k // 2, minmax_dedup._bitmap(np.array(sorted(own), np.uint64))))
    similar = {(a, b) for a, b in itertools.combinations(sets, 2) if a // 2 != b // 2 and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    whole = set(minmax_dedup.possible_pairs(rule, members, None))
    assert similar <= whole and len(whole) < 7140 // 2
    assert all(a < b and a // 2 != b // 2 for a, b in whole)
    assert set(minmax_dedup.possible_pairs(rule, members[:70], members[70:])) == {(a, b) for a, b in whole if a < 70 <= b}
