"""Readers of feeds, lists and archives as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text list: one a line, comments after " #", blanks skipped."""
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    return spark.read.text(path).select(line.alias("url")).where("url <> '' and not url rlike '\\\\s'")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: id, title, link, published, description."""
    schema = "guid string, title string, link string, pubDate string, description string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    stamp = F.regexp_replace("pubDate", "^[A-Za-z]{3}, *", "")
    return rows.select(
        F.coalesce("guid", "link").alias("id"),
        F.coalesce("title", F.expr("try_parse_url(link, 'HOST')"), F.lit("Untitled")).alias("title"),
        "link",
        F.coalesce(F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss z"))).alias("published"),
        "description",
    )


def archive_items(spark: SparkSession, path: str) -> DataFrame:
    """Markdown items with front matter: path, front, body."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    shape = r"(?s)^---\r?\n(.*?)\n---\r?\n?(.*)$"
    return rows.select(
        F.regexp_replace("_metadata.file_path", r"\.md$", "").alias("path"),
        F.regexp_extract("value", shape, 1).alias("front"),
        F.regexp_extract("value", shape, 2).alias("body"),
    ).where("front <> ''")
