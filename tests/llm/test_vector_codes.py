"""Vector codes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomarc.llm import queries, vector_codes
from loomarc.llm.vector_codes import Assignment, PartCodes, build_forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(vectors, rule):
    """(codes, errors, codebooks) by comparing every part with every entry."""
    width = vectors.shape[1] // rule.parts
    parts = [[tuple(int(x) for x in v[p * width : (p + 1) * width]) for v in vectors] for p in range(rule.parts)]
    books = [list(part[: rule.entries]) for part in parts]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (square(x, book[k]), k))
    for _ in range(rule.rounds):
        for part, book in zip(parts, books, strict=True):
            members = {}
            for x in part:
                members.setdefault(nearest(x, book), []).append(x)
            for k, own in members.items():
                book[k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    codes = [[nearest(x, book) for x in part] for part, book in zip(parts, books, strict=True)]
    errors = [sum(square(parts[p][i], books[p][codes[p][i]]) for p in range(rule.parts)) for i in range(len(vectors))]
    return [list(c) for c in zip(*codes, strict=True)], errors, books


def clustered(n, width, seed, spread=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 80, (9, width))
    return np.floor(centres[rng.integers(0, 9, n)] + rng.normal(0, spread, (n, width)))


@pytest.mark.parametrize("vectors", [clustered(700, 8, 1), clustered(300, 8, 2, 0), np.zeros((50, 8)), clustered(1, 8, 3), clustered(900, 8, 4, 60)])
def test_balls_give_what_comparing_all_gives(vectors):
    rule = PartCodes(parts=2, entries=16, leaf=5)
    forest = build_forest(vectors, rule)
    n, width = len(vectors), vectors.shape[1] // 2
    leaves = forest.child[:, 0] < 0
    assert sorted(i for a, b in forest.span[leaves] for i in range(a, b)) == list(range(2 * n))
    assert (forest.count[:2] == n).all() and (forest.total[:2] == vectors.reshape(n, 2, width).sum(0)).all()
    books = np.array([vectors[:16, :width], vectors[:16, width:]])
    plain = ((vectors.reshape(n, 2, 1, width).swapaxes(0, 1) - books[:, None]) ** 2).sum(3)
    want = plain.argmin(2)
    sums = Assignment(books)
    sums.add(forest)
    code, error = Assignment(books).add(forest, coded=True)
    assert (code == want).all() and (error == plain.min(2)).all()
    for p in range(2):
        for k in range(len(books[p])):
            own = vectors[want[p] == k][:, p * width : (p + 1) * width]
            assert sums.counts[p, k] == len(own) and (sums.sums[p, k] == own.sum(0)).all()


def test_most_points_of_clusters_are_never_compared():
    vectors = clustered(4000, 8, 5, 3)
    sums = Assignment(np.array([vectors[:9, :4], vectors[:9, 4:]]))
    sums.add(build_forest(vectors, PartCodes(parts=2)))
    assert sums.owned > 0 and sums.compared < 4000 and sums.counts.sum() == 8000


def test_compress(spark):
    rng = random.Random(3)
    vector = lambda: [rng.choice((rng.gauss(0, 1), rng.randrange(-2, 3) / 4)) for _ in range(8)]
    rows = [(k, vector(), rng.choice((1, 2, None))) for k in range(90, 0, -1)]
    rows += [rows[5], (None, vector(), 1), (3, vector(), 2), (200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [math.nan] * 8, 1), (203, [math.inf] * 8, 1), (204, [1.0] * 4, 1), (205, [], 1)]
    kept = [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], [np.float32(x) for x in r[1]]))
    whole = np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 256)
    for rule, parts in ((PartCodes(parts=4, entries=7, block=20, leaf=3), 3), (PartCodes(parts=4, entries=500), 1)):
        codes, errors, books = brute_force(whole, rule)
        table = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("codes", F.lit(1)).repartition(parts)
        coded, found = vector_codes.compress(table, rule)
        got = [(r.row.vec_id, r.row.label, r.codes, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()]
        of_label = {label: sum(e for e, r in zip(errors, kept, strict=True) if r[2] == label) for label in (1, 2, None)}
        want = [(r[0], r[2], c, e, of_label[r[2]]) for r, c, e in zip(kept, codes, errors, strict=True)]
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert [[tuple(map(int, e)) for e in book] for book in found] == books
    none, books = vector_codes.compress(table.limit(0))
    assert vector_codes.with_label_errors(none).count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table, PartCodes(parts=3))


def test_op11_on_few_rows(spark, tmp_path):
    rows = [(k, [0.5 * (k % 3)] * 64, None) for k in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in queries.op11_vector_codes(spark, str(tmp_path)).collect()}
    assert {k: (r.code, r.error, r.label_error) for k, r in got.items()} == {k: (f"{k % 3:02x}" * 16, 0, 0) for k in range(5)}
