"""Reply trees from parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

DEPTH, POSTS = 20, 32


def trees(posts: DataFrame, name: str, parent: str, at: str, depth: int = DEPTH) -> DataFrame:
    """(name, root, depth, path) of posts at most ``depth`` replies below a root.

    ``name`` is unique; a post whose parent is null or not among the posts is
    a root, and posts on a cycle reach none and go.  ``at`` is a number from 0
    that differs between siblings: ``path`` holds those of all steps from the
    root, so rows by root and path are in pre-order.  Each round joins every
    post that has not reached its root with the post it has climbed to, which
    doubles what is climbed, so rounds are the logarithm of ``depth`` and no
    thread is one task.  Answers to one post meet it in one task unless
    adaptive execution splits them.
    """
    links = posts.select(F.col(name).alias("name"), F.col(parent).alias("up"), F.lpad(F.col(at).cast("string"), 20, "0").alias("step"))
    present = posts.select(F.col(name).alias("up"))
    answers = links.where(F.col("up").isNotNull()).join(present, "up", "left_semi").select("name", "up", "step")
    links = links.join(answers.select("name"), "name", "left_anti").select("name", F.lit(None).cast(links.schema["up"].dataType).alias("up"), "step").union(answers)
    below = F.col("up").isNotNull()
    rows = links.select(
        "name",
        "up",
        F.coalesce("up", "name").alias("root"),
        below.cast("int").alias("depth"),
        F.when(below, F.concat(F.lit("/"), "step")).otherwise("").alias("path"),
    )
    climbing = F.col("up").isNotNull()
    for _ in range(depth.bit_length()):
        rows = written(rows, "threads")
        above = rows.select(F.col("name").alias("up"), *(F.col(c).alias(f"up_{c}") for c in ("up", "root", "depth", "path")))
        # Those that have reached their root stay where they are.
        climbed = rows.where(climbing).join(above, "up").select(
            "name",
            F.col("up_up").alias("up"),
            F.col("up_root").alias("root"),
            (F.col("depth") + F.col("up_depth")).alias("depth"),
            F.concat("up_path", "path").alias("path"),
        )
        rows = rows.where(~climbing).select("name", "up", "root", "depth", "path").union(climbed)
    return rows.where(F.col("up").isNull() & (F.col("depth") <= depth)).select(F.col("name").alias(name), "root", "depth", "path")


def self_replies(posts: DataFrame, name: str, parent: str, author: str, at: str, depth: int = DEPTH, most: int = POSTS, least: int = 2) -> DataFrame:
    """(name, root, depth, nth): threads of ``least`` or more posts that answer
    their own author.

    From each thread's first post down, nearest replies first, at most
    ``most`` posts; ``nth`` counts them from 0 in pre-order.  A post without
    an author answers nobody.
    """
    authors = posts.select(F.col(name).alias(parent), F.col(author).alias("_author"))
    own = posts.join(authors, parent, "left").withColumn("_up", F.when(F.col(author) == F.col("_author"), F.col(parent)))
    found = trees(own, name, "_up", at, depth)
    nearest = Window.partitionBy("root").orderBy("depth", "path")
    kept = found.withColumn("_near", F.row_number().over(nearest)).where(F.col("_near") <= most)
    thread = Window.partitionBy("root")
    kept = kept.withColumns({"nth": F.row_number().over(thread.orderBy("path")) - 1, "_posts": F.count("*").over(thread)})
    return kept.where(F.col("_posts") >= least).select(name, "root", "depth", "nth")
