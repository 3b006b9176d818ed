"""Reply trees against a walk in Python."""

import random

from loomarc.operators import threads


def _walk(rows, depth):
    names, children = {r[0] for r in rows}, {}
    for name, up, at, _ in rows:
        children.setdefault(up if up in names else None, []).append((at, name))
    found, order = {}, []

    def visit(name, root, d):
        found[name] = (root, d)
        order.append(name)
        for _, child in sorted(children.get(name, ())):
            if d < depth:
                visit(child, root, d + 1)

    for _, name in sorted(children.get(None, ())):
        visit(name, name, 0)
    return found, order


def test_trees(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, 999, *range(max(0, k - 6), k)]) if k else None, k, rng.choice("ab")) for k in range(60)]
    rows += [(k, k - 1 if k > 100 else None, k, "c") for k in range(100, 130)]  # deeper than allowed
    rows += [(200, 201, 200, "a"), (201, 200, 201, "a"), (300, 300, 300, "a"), (301, None, 301, None), (302, 301, 302, None)]
    posts = spark.createDataFrame(rows, "post long, parent long, at long, author string")
    for depth in (20, 3, 0):
        found, order = _walk(rows, depth)
        got = threads.trees(posts, "post", "parent", "at", depth).collect()
        assert {r["post"]: (r["root"], r["depth"]) for r in got} == found
        in_order = [r["post"] for r in sorted(got, key=lambda r: (r["root"], r["path"]))]
        assert in_order == sorted(order, key=lambda n: (found[n][0], order.index(n)))
    assert threads.trees(posts.limit(0), "post", "parent", "at").count() == 0


def test_self_replies(spark):
    rows = [(1, None, 1, "a"), (2, 1, 2, "a"), (3, 1, 3, "b"), (4, 2, 4, "a"), (5, 3, 5, "a"), (6, 1, 6, "a"), (7, 6, 7, None), (8, 7, 8, None)]
    rows += [(100 + k, 100 if k else None, 100 + k, "c") for k in range(40)]
    posts = spark.createDataFrame(rows, "post long, parent long, at long, author string")
    got = {r["post"]: (r["root"], r["depth"], r["nth"]) for r in threads.self_replies(posts, "post", "parent", "author", "at").collect()}
    assert {k: v for k, v in got.items() if k < 100} == {
        1: (1, 0, 0), 2: (1, 1, 1), 4: (1, 2, 2), 6: (1, 1, 3)
    }
    assert {k: v[2] for k, v in got.items() if k >= 100} == {100 + k: k for k in range(32)}
