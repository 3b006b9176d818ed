"""Link and publisher expressions, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "yclid", "_hsenc", "_hsmi")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(link: Column, n: int) -> Column:
    return F.regexp_extract(link, _PARTS, n)


def canonical_link(link: Column) -> Column:
    """The form under which links are one article.

    http without a port becomes https, the host is lower-cased without
    ``www.``, tracking parameters and the fragment go, the other parameters
    are sorted, and a last slash goes unless it is the path.  Text that is no
    link is trimmed.
    """
    link = F.trim(link)
    scheme, authority = F.lower(_part(link, 1)), F.lower(_part(link, 2))
    default = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(
        F.regexp_replace(authority, ":80$", "")
    )
    scheme = F.when((scheme == "http") & ~default.rlike(":[0-9]+$"), "https").otherwise(scheme)
    host = F.regexp_replace(default, r"^www\.", "")
    path = _part(link, 3)
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(
        F.split(_part(link, 4), "&"),
        lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING),
    )
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    query = F.array_join(pairs, "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(link.rlike(_PARTS), whole).otherwise(link)


CANONICAL_SQL = rf"""
  SELECT page_id, url, CASE WHEN NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') THEN trim(url) ELSE
    s2 || '://' || regexp_replace(a2, '^www\.', '') ||
    CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END ||
    CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS link
  FROM (SELECT *, CASE WHEN s = 'http' AND NOT regexp_matches(a2, ':[0-9]+$') THEN 'https' ELSE s END AS s2 FROM (
    SELECT page_id, url, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
      CASE WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https'
        THEN regexp_replace(lower(regexp_extract(trim(url), '://([^/?#]*)', 1)), ':443$', '')
        ELSE regexp_replace(lower(regexp_extract(trim(url), '://([^/?#]*)', 1)), ':80$', '') END AS a2,
      regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1) AS p,
      list_sort(list_transform(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda x:
        x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN
        {TRACKING}),
        lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q
    FROM pages))"""


def joined(base: Column, link: Column) -> Column:
    """A link as seen from ``base``, an absolute address; null where the link
    is null or the base is none."""
    link = F.trim(F.regexp_replace(link, r"[\t\r\n]", ""))
    scheme, host, path = _part(base, 1), F.concat(_part(base, 1), F.lit("://"), _part(base, 2)), _part(base, 3)
    whole = F.regexp_extract(link, r"^([^?#]*)", 1)  # the link's path
    after = F.substr(link, F.length(whole) + 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    way = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), whole))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(link.isNull() | ~base.rlike(_PARTS), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(whole == "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(after.startswith("?"), after).otherwise(F.concat(query, after))))
        .otherwise(F.concat(host, _without_dots(way), after))
    )


def _without_dots(path: Column) -> Column:
    """``.`` steps go, and ``..`` steps with the step before them."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(steps, -1)
    none = F.array().cast("array<string>")
    pop = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(steps, none, lambda done, s: F.when(s == ".", done).when(s == "..", pop(done)).otherwise(F.array_append(done, s)))
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def domain(link: Column) -> Column:
    """Host without ``www.``; empty where the text is no link."""
    host = F.regexp_replace(F.lower(_part(F.trim(link), 2)), r"^[^@]*@|:[0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def dedupe_keys(identifier: Column, link: Column, title: Column, published: Column) -> Column:
    """Up to three keys, by identifier, link, and title with date; rows are
    the same entry when any key is."""
    ident, named = F.nullif(F.trim(identifier), F.lit("")), F.nullif(F.lower(F.trim(title)), F.lit(""))
    stamp = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.sha1(F.concat(F.lit("id:"), ident)),
                F.sha1(F.concat(F.lit("link:"), F.nullif(canonical_link(link), F.lit("")))),
                F.sha1(F.concat(F.lit("title:"), named, F.lit("|"), stamp)),
            )
        )
    )


#: Extensions of media (fixed values).
VIDEO = ("mp4", "m4v", "webm", "mov", "ogv")
AUDIO = ("mp3", "m4a", "ogg", "oga", "opus", "wav", "flac", "aac")
IMAGE = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg")

#: Hosts whose links are videos (fixed values).
VIDEO_HOSTS = ("youtube.com", "m.youtube.com", "youtu.be", "vimeo.com", "twitch.tv")


def item_type(link: Column, enclosure: Column) -> Column:
    """video, document, podcast, audio, image or article."""
    host, extension = domain(link), F.lower(F.regexp_extract(_part(F.trim(link), 3), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(host.isin(*VIDEO_HOSTS) | extension.isin(*VIDEO), "video")
        .when(extension == "pdf", "document")
        .when(extension.isin(*AUDIO), F.when(enclosure.isNotNull(), "podcast").otherwise("audio"))
        .when(enclosure.isNotNull(), "podcast")
        .when(extension.isin(*IMAGE), "image")
        .otherwise("article")
    )
