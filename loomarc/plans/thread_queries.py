"""Reply trees: turn n of a conversation answers turn (n - 1) div 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads
from .registry import query, table

_POSTS = """posts AS (SELECT conv_id || ':' || turn AS post, CASE WHEN turn > 0 THEN conv_id || ':' || ((turn - 1) // 2) END AS parent, role, turn
    FROM conversations)"""


def _posts(spark, sf):
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    parent = F.when(F.col("turn") > 0, name(F.expr("(turn - 1) div 2")))
    return table(spark, sf, "conversations").select(name(F.col("turn")).alias("post"), parent.alias("parent"), "role", "turn")


@query(
    f"""WITH RECURSIVE {_POSTS},
    t AS (SELECT post, post AS root, 0 AS depth, '' AS path FROM posts WHERE parent IS NULL OR parent NOT IN (SELECT post FROM posts)
      UNION ALL SELECT p.post, t.root, t.depth + 1, t.path || '/' || lpad(p.turn::VARCHAR, 20, '0') FROM t JOIN posts p ON p.parent = t.post)
    SELECT post, root, depth, path FROM t WHERE depth <= {threads.DEPTH}"""
)
def thread_trees(spark, sf):
    return threads.trees(_posts(spark, sf), "post", "parent", "turn")


@query(
    f"""WITH RECURSIVE {_POSTS},
    own AS (SELECT p.post, p.turn, CASE WHEN p.role = q.role THEN p.parent END AS up FROM posts p LEFT JOIN posts q ON q.post = p.parent),
    t AS (SELECT post, post AS root, 0 AS depth, '' AS path FROM own WHERE up IS NULL
      UNION ALL SELECT p.post, t.root, t.depth + 1, t.path || '/' || lpad(p.turn::VARCHAR, 20, '0') FROM t JOIN own p ON p.up = t.post)
    SELECT post, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS nth FROM (SELECT *,
      row_number() OVER (PARTITION BY root ORDER BY depth, path) AS near FROM t WHERE depth <= {threads.DEPTH}) WHERE near <= {threads.POSTS}"""
)
def self_threads(spark, sf):
    return threads.self_replies(_posts(spark, sf), "post", "parent", "role", "turn", least=1)
