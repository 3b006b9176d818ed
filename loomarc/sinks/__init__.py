"""Serialised items and collections as text columns, for any text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escaped
from ..operators import cuts
from ..session import written


def element(name: str, value: Column) -> Column:
    """An XML element; null where the value is, so that it is left out."""
    return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))


def rss_item(identifier: Column, link: Column, title: Column, summary: Column, published: Column) -> Column:
    stamp = F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    parts = (element("title", title), element("link", link), element("guid", identifier), element("pubDate", stamp), element("description", summary))
    return F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>"))


def atom_entry(identifier: Column, link: Column, title: Column, summary: Column, updated: Column) -> Column:
    stamp = F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    href = F.concat(F.lit('<link href="'), escaped(link), F.lit('"/>'))
    parts = (element("id", identifier), href, element("title", title), element("updated", stamp), element("summary", summary))
    return F.concat(F.lit("<entry>"), F.concat_ws("", *parts), F.lit("</entry>"))


#: What a sitemap file has around its entries (fixed values of the format).
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
SITEMAP_TAIL = "</urlset>\n"


def sitemap_entry(link: Column, modified: Column) -> Column:
    stamp = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.concat(F.lit("    "), element(name, value), F.lit("\n")) for name, value in (("loc", link), ("lastmod", stamp))]
    return F.concat(F.lit("  <url>\n"), F.concat_ws("", *parts), F.lit("  </url>\n"))


def sitemap_files(urls: DataFrame, link: str, modified: str, most_urls: int = 50_000, most_bytes: int = 50 << 20) -> DataFrame:
    """urls with ``entry``, the ``file`` (from 1, in the order of links) that
    holds it, and that file's ``urls``, ``bytes`` and ``lastmod``.

    A file is full at so many URLs or bytes, those around its entries
    included.  An entry too large for any file ends the job with an error;
    links must differ.  Only the size of an entry goes through the cutting.
    """
    entry = sitemap_entry(F.col(link), F.col(modified))
    room = most_bytes - len(SITEMAP_HEAD + SITEMAP_TAIL)
    size = F.octet_length(entry).cast("long")
    fits = F.when(size <= room, size).otherwise(F.raise_error(F.concat(F.lit("sitemap entry too large: "), F.col(link))).cast("long"))
    rows = urls.withColumn("_bytes", fits)
    rows = written(cuts.cut(rows, [], [link], cuts.Limits(most_urls, {"_bytes": room})).withColumn("file", F.col("group") + 1).drop("group"), "sitemap")
    files = rows.groupBy("file").agg(F.count("*").alias("urls"), (F.sum("_bytes") + most_bytes - room).alias("bytes"), F.max(modified).alias("lastmod"))
    return rows.withColumn("entry", entry).drop("_bytes").join(files, "file")


def json_item(identifier: Column, link: Column, title: Column, body: Column, tags: Column) -> Column:
    return F.to_json(F.struct(identifier.alias("id"), link.alias("url"), title.alias("title"), body.alias("content_text"), tags.alias("tags")))


def outline(name: Column, feed: Column) -> Column:
    """One subscription of an OPML list."""
    return F.concat(F.lit('<outline type="rss" text="'), escaped(name), F.lit('" xmlUrl="'), escaped(feed), F.lit('"/>'))


def markdown_item(front: dict[str, Column], body: Column) -> Column:
    """Body under front matter of quoted values; null fields are left out."""
    quoted = lambda v: F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    lines = [F.concat(F.lit(f'{name}: "'), quoted(value), F.lit('"')) for name, value in front.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def collections(items: DataFrame, group: str, name: str, order: list[Column], entry: Column, head: Column, tail: Column, top: int, between: str = "") -> DataFrame:
    """(group, items, body): the ``top`` first entries of each group between a
    head and a tail, parted by ``between``.

    Ranks are found on keys alone, ``top`` a group leaving each task, so a
    group's size does not matter; only then do the chosen texts move.
    """
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= top)
    entries = items.join(ranked.select(name, "_rank"), name).select(group, F.struct("_rank", entry.alias("entry")).alias("_entry"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_entry")), lambda e: e["entry"]), between)
    return entries.groupBy(group).agg(F.count("*").alias("items"), body.alias("_body")).select(group, "items", F.concat(head, "_body", tail).alias("body"))
