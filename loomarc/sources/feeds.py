"""Entries of feed files: RSS, RDF, Atom and JSON Feed.

Spark reads the files as bytes (each in one piece, wherever they are stored,
with its filters on names, sizes and times), a small parser turns a file into
rows of raw fields, and expressions make items of those.  A file that cannot be
read gives one row with its error; Spark leaves out files without any bytes.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Namespaces of feeds (fixed values).
ATOM = "{http://www.w3.org/2005/Atom}"
ITUNES = "{http://www.itunes.com/dtds/podcast-1.0.dtd}"
MEDIA = "{http://search.yahoo.com/mrss/}"
CONTENT = "{http://purl.org/rss/1.0/modules/content/}"
DC = "{http://purl.org/dc/elements/1.1/}"
XML = "{http://www.w3.org/XML/1998/namespace}"

_LINK = "struct<href:string,rel:string,type:string>"
_FILE = "struct<url:string,type:string,bytes:string,duration:string>"
RAW = (
    "position int, feed_title string, feed_links array<" + _LINK + ">, feed_language string, id string, title string, links array<" + _LINK + ">, "
    "published string, updated string, authors array<string>, labels array<string>, summary string, content string, content_is_html boolean, "
    "files array<" + _FILE + ">, duration string, pictures array<string>, description string, error string"
)


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def repaired(raw: bytes) -> str:
    """A document with what breaks readers put right: bytes before the first
    ``<``, characters that XML forbids, HTML's named entities, bare ``&``."""
    declared = re.match(rb"[^<]{0,9}<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", raw)
    try:
        text = raw.decode(declared[1].decode() if declared else "utf-8")
    except (LookupError, UnicodeDecodeError):
        text = raw.decode("utf-8", "replace")
    text = re.sub(r"^[^<]*<\?xml[^>]*\?>|^[^<]+", "", text, count=1)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    # Sections of character data are left as they are.
    parts = re.split(r"(<!\[CDATA\[.*?\]\]>)", text, flags=re.S)
    return "".join(p if k % 2 else re.sub(r"&(#\d+;|#x[0-9A-Fa-f]+;|\w+;)?", _entity, p) for k, p in enumerate(parts))


def _entity(found: re.Match) -> str:
    name = found[1]
    if name is None:
        return "&amp;"
    if name[0] == "#" or name in ("amp;", "lt;", "gt;", "quot;", "apos;"):
        return found[0]
    return html.unescape(found[0]) if html.unescape(found[0]) != found[0] else "&amp;" + name


def _inside(element: ET.Element) -> str:
    """The text of an element, or the markup of its children."""
    if not len(element):
        return element.text or ""
    for child in element.iter():
        child.tag = _name(child)
    return (element.text or "") + "".join(ET.tostring(c, "unicode", "html") for c in element)


def _texts(parent: ET.Element, *names: str) -> list[str]:
    """Texts of the children of these names (without a namespace also in any
    that feeds use as their own), names in the order given, blank ones left out."""
    found = []
    for name in names:
        for child in parent:
            if child.tag == name or ("{" not in name and _name(child) == name and not str(child.tag).startswith((MEDIA, ITUNES, CONTENT, DC))):
                found.append(_inside(child).strip() if len(child) else (child.text or "").strip())
    return [t for t in found if t]


def _first(parent: ET.Element, *names: str) -> str | None:
    return next(iter(_texts(parent, *names)), None)


def _links(parent: ET.Element, base: str) -> list[dict]:
    found = []
    for child in parent:
        if _name(child) == "link" and not str(child.tag).startswith((MEDIA, ITUNES)):
            href = child.get("href") or (child.text or "").strip()
            if href:
                found.append({"href": urljoin(base, href), "rel": child.get("rel"), "type": child.get("type")})
    return found


def _person(child: ET.Element) -> str | None:
    """``mail@host (Name)`` of RSS, or the name, else the mail, of Atom."""
    name, mail = _first(child, "name"), _first(child, "email")
    whole = name or mail or (child.text or "").strip()
    inside = re.search(r"\(([^()]+)\)$", whole)
    return (inside[1].strip() if inside else whole) or None


def _entry(entry: ET.Element, base: str) -> dict:
    base = urljoin(base, entry.get(XML + "base", ""))
    groups = [entry, *[g for g in entry if g.tag == MEDIA + "group"]]
    files = [{"url": c.get("url"), "type": c.get("type"), "bytes": c.get("length"), "duration": None} for c in entry if _name(c) == "enclosure"]
    files += [{"url": c.get("href"), "type": c.get("type"), "bytes": c.get("length"), "duration": None} for c in entry if c.tag == ATOM + "link" and c.get("rel") == "enclosure"]
    files += [{"url": c.get("url"), "type": c.get("type"), "bytes": c.get("fileSize"), "duration": c.get("duration")} for g in groups for c in g if c.tag == MEDIA + "content"]
    files = [f | {"url": urljoin(base, f["url"].strip())} for f in files if f["url"] and f["url"].strip()]
    pictures = [c.get("url") for g in groups for c in g if c.tag == MEDIA + "thumbnail"] + [c.get("href") for c in entry if c.tag == ITUNES + "image"]
    content = next((c for c in entry if c.tag in (ATOM + "content", CONTENT + "encoded") and _inside(c).strip()), None)
    kind = None if content is None else "html" if content.tag == CONTENT + "encoded" else content.get("type", "text")
    people = [_person(c) for c in entry if _name(c) in ("author", "creator") and not str(c.tag).startswith((ITUNES, MEDIA))]
    said = [t for g in groups for t in _texts(g, MEDIA + "description")]
    return {
        "id": _first(entry, "id", "guid"),
        "title": _first(entry, "title"),
        "links": [x for x in _links(entry, base) if x["rel"] != "enclosure"],
        "published": _first(entry, "published", "pubDate", "issued", DC + "date"),
        "updated": _first(entry, "updated", "modified"),
        "authors": [p for p in people if p and p != "author"],
        "labels": [x for c in entry if _name(c) in ("category", "subject") if (x := (c.get("label") or c.get("term") or c.text or "").strip())],
        "summary": _first(entry, "summary", "description"),
        "content": None if content is None else _inside(content).strip(),
        "content_is_html": None if kind is None else bool(re.search("html", kind)),
        "files": files,
        "duration": _first(entry, ITUNES + "duration"),
        "pictures": [urljoin(base, p.strip()) for p in pictures if p and p.strip()],
        "description": next(iter(said), None),
    }


def _json_entry(entry: dict, base: str) -> dict:
    text = lambda value: value if isinstance(value, str) and value.strip() else None
    people = entry.get("authors") or ([entry["author"]] if isinstance(entry.get("author"), dict) else [])
    files = [f for f in entry.get("attachments") or [] if isinstance(f, dict) and text(f.get("url"))]
    links = [u for k in ("url", "external_url") if (u := text(entry.get(k)))]
    spell = lambda value: None if value is None else str(value)
    return {
        "id": spell(entry.get("id")),
        "title": text(entry.get("title")),
        "links": [{"href": urljoin(base, u), "rel": None, "type": None} for u in links],
        "published": text(entry.get("date_published")),
        "updated": text(entry.get("date_modified")),
        "authors": [n for p in people if isinstance(p, dict) and (n := text(p.get("name")))],
        "labels": [t.strip() for t in entry.get("tags") or [] if text(t)],
        "summary": text(entry.get("summary")),
        "content": text(entry.get("content_html")) or text(entry.get("content_text")),
        "content_is_html": text(entry.get("content_html")) is not None,
        "files": [{"url": urljoin(base, f["url"]), "type": text(f.get("mime_type")), "bytes": spell(f.get("size_in_bytes")), "duration": spell(f.get("duration_in_seconds"))} for f in files],
        "duration": None,
        "pictures": [urljoin(base, u) for k in ("image", "banner_image") if (u := text(entry.get(k)))],
        "description": None,
    }


def entries(raw: bytes, base: str) -> list[dict]:
    """Raw fields of the entries of a feed, in its order; ValueError where the
    bytes are no feed.  Relative links are resolved against ``base``."""
    if raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"{":
        feed = json.loads(raw.decode("utf-8-sig"))
        if not isinstance(feed.get("items"), list):
            raise ValueError("a JSON document without items is no feed")
        base = feed.get("feed_url") or base
        home = [{"href": feed["home_page_url"], "rel": None, "type": None}] if feed.get("home_page_url") else []
        head = {"feed_title": feed.get("title"), "feed_links": home, "feed_language": feed.get("language")}
        return [head | {"position": k} | _json_entry(e, base) for k, e in enumerate(feed["items"]) if isinstance(e, dict)]
    root = ET.fromstring(repaired(raw))
    if _name(root) not in ("rss", "feed", "RDF"):
        raise ValueError(f"a document of {_name(root)} is no feed")
    base = urljoin(base, root.get(XML + "base", ""))
    head = root if _name(root) == "feed" else next((c for c in root if _name(c) == "channel"), root)
    about = {"feed_title": _first(head, "title"), "feed_links": _links(head, base), "feed_language": root.get(XML + "lang") or _first(head, "language", DC + "language")}
    found = [e for e in root.iter() if _name(e) in ("item", "entry")]
    return [about | {"position": k} | _entry(e, base) for k, e in enumerate(found)]


def _parsed(base: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.split(r", (?=\w+ )", RAW)]
        for files in batches:
            for path, raw in zip(files["path"], files["content"], strict=True):
                try:
                    rows = entries(bytes(raw), base or path)
                except (ValueError, ET.ParseError, AttributeError, RecursionError) as problem:
                    rows = [{"error": f"{type(problem).__name__}: {problem}"}]
                if rows:
                    yield pd.DataFrame({"file": path} | {n: [r.get(n) for r in rows] for n in names}).astype({"position": "Int32", "content_is_html": "boolean"})

    return run


def raw_entries(spark: SparkSession, path: str | list[str], base: str | None = None, glob: str | None = None, newer_than: str | None = None) -> DataFrame:
    """A row of :data:`RAW` fields for each entry of each feed file.

    ``glob`` selects file names and ``newer_than`` (a UTC time) the files
    changed since, both before any file is read; ``base`` resolves relative
    links, else each file's own path does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", glob) if glob else files
    files = files.option("modifiedAfter", newer_than) if newer_than else files
    return files.load(path).select("path", "content").mapInPandas(_parsed(base), f"file string, {RAW}")


def picked_link(links: Column) -> Column:
    """The HTML alternate of links, else the first."""
    html_ = F.filter(links, lambda x: F.coalesce(x["rel"], F.lit("alternate")).eqNullSafe("alternate") & F.coalesce(x["type"], F.lit("text/html")).startswith("text/html"))
    return F.coalesce(F.get(html_, F.lit(0)), F.get(links, F.lit(0)))["href"]


def feed_time(text: Column) -> Column:
    """Times of RFC 2822, RFC 3339 or a day; UTC where no zone is named."""
    mail = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3,9}, *", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    shapes = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(mail, F.lit(s)) for s in shapes])


def paragraphs(text: Column) -> Column:
    """Plain text as HTML: blank lines part paragraphs, others break lines."""
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.array_join(F.transform(F.split(plain, "\n\n"), lambda p: F.concat(F.lit("<p>"), F.regexp_replace(F.trim(p), "\n", "<br>"), F.lit("</p>"))), "\n")


def feed_items(raw: DataFrame) -> DataFrame:
    """Items of :func:`raw_entries`: file, position, error, feed_title,
    feed_site, id, title, link, published, updated, authors, labels, summary,
    content, audio, duration_seconds, thumbnail, pictures.

    The link is the HTML alternate, else the first, else an id that is a URL,
    else the audio's; an entry without any is no item, nor is a short video.
    Titles and summaries are plain text; an entry without a title is named by
    its host.  A file with an error stays as a row.
    """
    audio = F.get(F.filter("files", lambda f: f["type"].startswith("audio/") & f["url"].rlike("^https?://")), F.lit(0))
    rows = raw.withColumn("audio", audio)
    link = F.coalesce(picked_link(F.col("links")), F.when(F.col("id").rlike("^https?://"), F.col("id")), F.col("audio")["url"])
    video = F.coalesce(F.lower(F.try_parse_url("link", F.lit("HOST"))).rlike(r"(^|\.)(youtube\.com|youtu\.be|vimeo\.com)$"), F.lit(False))
    said = F.when(video, F.nullif(F.col("description"), F.lit("")))
    body = F.when(F.col("content_is_html"), F.col("content")).otherwise(paragraphs(F.col("content")))
    known = F.filter("files", lambda f: (f["url"] == F.col("audio")["url"]) | (f["url"] == F.col("link")))
    playing = F.filter("files", lambda f: f["type"].rlike("^(audio|video)/"))
    duration = F.coalesce(
        tx.duration_seconds(F.trim(F.get(F.transform(F.filter(known, lambda f: f["duration"].isNotNull()), lambda f: f["duration"]), F.lit(0)))),
        tx.duration_seconds(F.trim(F.col("duration"))),
        tx.duration_seconds(F.trim(F.get(F.transform(F.filter(playing, lambda f: f["duration"].isNotNull()), lambda f: f["duration"]), F.lit(0)))),
    )
    rows = rows.withColumn("link", link).where(F.col("error").isNotNull() | (F.col("link").isNotNull() & ~F.col("link").rlike(r"^https?://(www\.|m\.)?youtube\.com/shorts/")))
    text = lambda c: F.nullif(tx.html_text(c), F.lit(""))
    site = picked_link(F.filter("feed_links", lambda x: F.coalesce(x["rel"], F.lit("alternate")) == "alternate"))
    picture_files = F.transform(F.filter("files", lambda f: f["type"].startswith("image/")), lambda f: f["url"])
    return rows.select(
        "file", "position", "error", text(F.col("feed_title")).alias("feed_title"), site.alias("feed_site"), tx.language_tag(F.col("feed_language")).alias("feed_language"),
        F.nullif(F.trim("id"), F.lit("")).alias("id"),
        F.when(F.col("error").isNull(), F.coalesce(text(F.col("title")), F.try_parse_url("link", F.lit("HOST")), F.lit("Untitled"))).alias("title"),
        "link", F.coalesce(feed_time(F.col("published")), feed_time(F.col("updated"))).alias("published"), feed_time(F.col("updated")).alias("updated"),
        "authors", "labels", F.coalesce(text(F.col("summary")), text(said)).alias("summary"), F.coalesce(body, F.when(F.trim("summary") != "", F.col("summary")), paragraphs(said)).alias("content"),
        F.when(F.col("audio").isNotNull(), F.struct(F.col("audio.url").alias("url"), F.col("audio.type").alias("type"), F.nullif(F.col("audio.bytes").try_cast("long"), F.lit(0)).alias("bytes"))).alias("audio"),
        duration.alias("duration_seconds"), F.get("pictures", F.lit(0)).alias("thumbnail"), F.array_distinct(F.concat("pictures", picture_files)).alias("pictures"),
    )
