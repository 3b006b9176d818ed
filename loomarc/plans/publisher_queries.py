"""Publishers of links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import publishers
from .registry import query, table

#: The tables hold ordinary sites; by page_id, their paths go below these too.
_PLACES = (
    "https://www.GitHub.com.", "https://github.com/Search", "https://twitter.com", "https://open.spotify.com/show", "https://pca.st/episode",
    "http://old.reddit.com:80/r", "https://youtube.com/watch", "https://social.example:8443/@who", "https://vimeo.com/12",
    "https://www.youtube.com/feeds/videos.xml?channel_id=UC", "ftp://github.com/files",
)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_SERVED = " OR ".join(f"(h = '{h}' AND lower(s[1]) IN {_in(names)})" for h, names in publishers.RESERVED.items())
_PREFIXED = " OR ".join(f"(h = '{h}' AND s[1] IN {_in(names)})" for h, names in publishers.PREFIXED.items())
_ALIASED = "CASE h " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in publishers.ALIASES.items()) + " ELSE h END"


@query(
    rf"""WITH links AS (SELECT page_id, CASE WHEN page_id % {len(_PLACES) + 1} = 0 THEN url ELSE
      [{", ".join(f"'{p}'" for p in _PLACES)}][page_id % {len(_PLACES) + 1}] || regexp_extract(url, '://[^/?#]*(.*)$', 1) END AS link FROM pages),
    raw AS (SELECT page_id, lower(regexp_extract(link, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(link, '://([^/?#]*)', 1)) AS a,
      regexp_extract(link, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(link, '\?([^#]*)', 1) AS q FROM links),
    hosts AS (SELECT *, regexp_extract(a, ':([0-9]+)$', 1) AS port, list_filter(string_split(p, '/'), lambda x: x <> '') AS s,
      regexp_replace(regexp_replace(regexp_replace(a, ':[0-9]*$', ''), '\.+$', ''), '^www\.', '') AS h FROM raw),
    named AS (SELECT * REPLACE (CASE WHEN scheme IN ('http', 'https') THEN {_ALIASED} END AS h) FROM hosts),
    found AS (SELECT *, CASE WHEN len(s) = 0 OR {_SERVED} OR (h IN {_in(publishers.NUMBERED)} AND regexp_full_match(s[1], '[0-9]+')) THEN NULL
      WHEN s[1] LIKE '@_%' THEN s[1] WHEN h IN {_in(publishers.CATALOGUES)} THEN
        CASE WHEN s[1] NOT IN {_in(publishers.ENTRIES)} THEN array_to_string(s, '/') END
      WHEN h IN {_in(publishers.NAMED)} THEN s[1] WHEN ({_PREFIXED}) AND len(s) > 1 THEN s[1] || '/' || s[2] END AS account FROM named)
    SELECT page_id, account, h || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
      || coalesce('/' || account, '') AS publisher, coalesce(h IN {_in(publishers.CATALOGUES)}, false) AS opaque,
      CASE WHEN h = 'youtube.com' AND regexp_replace(p, '/+$', '') = '/feeds/videos.xml' AND regexp_matches(q, '(^|&)(channel_id|user)=')
        THEN CASE WHEN regexp_extract(q, '(?:^|&)(channel_id|user)=', 1) = 'user' THEN '/user/' ELSE '/channel/' END
        || url_decode(regexp_extract(q, '(?:^|&)(?:channel_id|user)=([^&]*)', 1)) END AS channel FROM found"""
)
def publisher_names(spark, sf):
    """Publishers of the pages' links, of which most are moved to shared hosts."""
    at, rest = F.pmod("page_id", F.lit(len(_PLACES) + 1)), F.regexp_extract("url", "://[^/?#]*(.*)$", 1)
    place = F.get(F.array(*map(F.lit, _PLACES)), (at - 1).cast("int"))
    link = F.when(at == 0, F.col("url")).otherwise(F.concat(place, rest))
    pages = table(spark, sf, "pages").select("page_id", link.alias("link"))
    return pages.select(
        "page_id",
        publishers.account_path(F.col("link")).alias("account"),
        publishers.publisher(F.col("link")).alias("publisher"),
        publishers.opaque(F.col("link")).alias("opaque"),
        publishers.channel_path(F.col("link")).alias("channel"),
    )
