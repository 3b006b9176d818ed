"""Who published a link: the host, with the account's path where many publishers share it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Other hosts of a platform (fixed values).
ALIASES = {
    "youtu.be": "youtube.com",
    "m.youtube.com": "youtube.com",
    "music.youtube.com": "youtube.com",
    "twitter.com": "x.com",
    "mobile.twitter.com": "x.com",
    "old.reddit.com": "reddit.com",
    "np.reddit.com": "reddit.com",
    "player.vimeo.com": "vimeo.com",
    "m.twitch.tv": "twitch.tv",
    "open.spotify.com": "spotify.com",
    "pca.st": "pocketcasts.com",
    "play.pocketcasts.com": "pocketcasts.com",
}

#: Platforms whose first segment is an account (fixed values).
NAMED = ("codeberg.org", "github.com", "gitlab.com", "medium.com", "soundcloud.com", "twitch.tv", "vimeo.com", "x.com")

#: Platforms whose accounts follow one of these segments (fixed values).
PREFIXED = {
    "bsky.app": ("profile",),
    "reddit.com": ("r", "user"),
    "youtube.com": ("channel", "user", "c"),
}

#: Catalogues, whose whole path names a show unless it begins with an entry (fixed values).
CATALOGUES = ("castbox.fm", "overcast.fm", "pocketcasts.com", "podcasts.apple.com", "spotify.com")
ENTRIES = ("episode", "episodes")

#: Platforms where a first segment of digits is a piece of content (fixed values).
NUMBERED = ("vimeo.com",)

#: First segments that a platform serves itself, as its robots.txt or source
#: names them (fixed values); another set can be given as ``reserved``.
RESERVED = {
    "codeberg.org": (
        "-", ".", "..", ".well-known", "actor", "admin", "api", "assets", "attachments", "avatar", "avatars", "captcha", "explore",
        "favicon.ico", "forgejo-actions", "ghost", "gitea-actions", "issues", "login", "manifest.json", "metrics", "milestones",
        "notifications", "org", "pulls", "repo", "repo-avatars", "report_abuse", "robots.txt", "sitemap.xml", "ssh_info", "swagger.v1.json",
        "user", "v2",
    ),
    "github.com": (
        ".git", "about", "copilot", "customer-stories", "enterprise", "features", "gist", "marketplace", "mcp", "newsroom", "pricing",
        "resources", "search", "security", "solutions",
    ),
    "gitlab.com": (
        "-", ".well-known", "404.html", "422.html", "500.html", "502.html", "503.html", "admin", "api", "apple-touch-icon.png", "assets",
        "dashboard", "deploy.html", "explore", "favicon.ico", "favicon.png", "groups", "health_check", "help", "import", "jwt", "login", "o",
        "oauth", "profile", "projects", "public", "robots.txt", "s", "search", "sitemap", "sitemap.xml", "sitemap.xml.gz",
        "slash-command-logo.png", "snippets", "unsubscribes", "uploads", "users", "v2",
    ),
    "medium.com": (
        "@me", "_", "about", "business", "earn", "gift", "m", "me", "media", "membership", "p", "partner-program", "r", "search", "trending",
        "verified-authors",
    ),
    "soundcloud.com": (
        "accessibility-statement", "community-guidelines", "company", "discover", "download", "getstarted", "go", "imprint", "jobs", "messages",
        "pro", "search", "settings", "sitemap", "sitemapindex", "stories", "stream", "terms-of-use", "topic", "transparency-reports", "upload",
        "you",
    ),
    "twitch.tv": (
        ".well-known", "activate", "admin", "auth", "beta", "bits-checkout", "chat", "claim", "collab", "copyright-claims", "directory",
        "dj-signup", "download-keys", "drops", "email-unsubscribe", "embed", "extensions", "gl", "guest-star", "inventory", "login", "message",
        "moderator", "oss-attribution", "payments", "popout", "r", "redeem", "report-appeal", "search", "settings", "signup",
        "sportradar-widgets", "sq", "stale", "stream", "subscriptions", "user", "videos", "wallet", "wv",
    ),
    "vimeo.com": (
        "_", "_global_notifications", "_next", "_rv", "about", "album", "api", "blog", "campaigns", "channels", "couchmode", "create",
        "customers", "de", "download", "enterprise", "es", "event", "events", "features", "forgot_password", "fr", "groups", "help",
        "integrations", "jp", "ko", "legal", "manage", "musicstore", "ondemand", "ott", "product", "pt-br", "reviews", "search", "solutions",
        "store", "upgrade-plan", "user", "video-uploader", "vimeo-academy",
    ),
    "x.com": (
        "account", "hashtag", "i", "search", "settings",
    ),
}


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def host(link: Column) -> Column:
    """Host without ``www.`` and last dots, a platform's under one name; null
    unless the link is http or https."""
    link = F.trim(link)
    plain = F.regexp_replace(F.lower(urls._part(link, 2)), r"^[^@]*@|:[0-9]*$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.+$", ""), r"^www\.", "")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(F.lower(urls._part(link, 1)).isin("http", "https") & (plain != ""), F.coalesce(F.element_at(known, plain), plain))


def account_path(link: Column, reserved: Mapping[str, Sequence[str]] = RESERVED) -> Column:
    """Path of the account that published a link, without a first slash; null
    where the host is all that is known."""
    where = F.coalesce(host(link), F.lit(""))
    segments = F.filter(F.split(urls._part(F.trim(link), 3), "/"), lambda s: s != "")
    first = F.get(segments, 0)
    served = _any([(where == h) & F.lower(first).isin(*names) for h, names in reserved.items()])
    served = served | (where.isin(*NUMBERED) & first.rlike("^[0-9]+$"))
    prefixed = _any([(where == h) & first.isin(*names) for h, names in PREFIXED.items()])
    return (
        F.when(first.isNull() | served, None)
        .when(first.rlike("^@."), first)
        .when(where.isin(*CATALOGUES), F.when(~first.isin(*ENTRIES), F.array_join(segments, "/")))
        .when(where.isin(*NAMED), first)
        .when(prefixed & (F.size(segments) > 1), F.array_join(F.slice(segments, 1, 2), "/"))
    )


def publisher(link: Column, reserved: Mapping[str, Sequence[str]] = RESERVED) -> Column:
    """Canonical name of a link's publisher: host, port unless it is the
    scheme's own, and account path; null where the link is not http or https."""
    scheme, port = F.lower(urls._part(F.trim(link), 1)), F.regexp_extract(urls._part(F.trim(link), 2), ":([0-9]+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    authority = F.concat(host(link), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    return F.when(host(link).isNotNull(), F.concat_ws("/", authority, account_path(link, reserved)))


def opaque(link: Column) -> Column:
    """Whether accounts of the link's host are identifiers that nobody reads."""
    return F.coalesce(host(link).isin(*CATALOGUES), F.lit(False))


def channel_path(link: Column) -> Column:
    """Path of the channel behind a YouTube feed; null for other links."""
    link = F.trim(link)
    feed = (host(link) == "youtube.com") & (F.regexp_replace(urls._part(link, 3), "/+$", "") == "/feeds/videos.xml")
    kind = F.regexp_extract(urls._part(link, 4), "(?:^|&)(channel_id|user)=([^&]*)", 1)
    value = F.try_url_decode(F.regexp_extract(urls._part(link, 4), "(?:^|&)(channel_id|user)=([^&]*)", 2))
    return F.when(feed & (kind != ""), F.concat(F.when(kind == "user", "/user/").otherwise("/channel/"), value))
