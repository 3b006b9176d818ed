"""Text expressions: normal forms, excerpts, terms, shingles, HTML to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in titles (fixed values).
STOPWORDS = (
    "about", "after", "again", "against", "also", "and", "are", "but", "for", "from", "has",
    "have", "how", "into", "its", "not", "of", "on", "our", "that", "the", "their", "this",
    "through", "to", "using", "was", "what", "when", "where", "which", "with", "you", "your",
)

WORDS_A_MINUTE = 225


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def category(name: Column) -> Column:
    return F.nullif(F.lower(collapsed(name)), F.lit(""))


def labels(names: Column) -> Column:
    """Lower-case labels without ``#``, sorted, each once."""
    each = F.transform(names, lambda n: F.lower(F.regexp_replace(collapsed(n), "^#+", "")))
    return F.array_sort(F.array_distinct(F.filter(each, lambda n: n != "")))


def slug(name: Column, empty: str = "other") -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(empty))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def fingerprint(text: Column, least: int = 64) -> Column:
    """sha1 of a text's words; null for texts of fewer words."""
    return F.when(F.size(words(text)) >= least, F.sha1(F.concat(F.array_join(words(text), " "), F.lit(" "))))


def reading_minutes(n_words: Column) -> Column:
    return F.ceil(n_words / WORDS_A_MINUTE).cast("long")


def excerpt(text: Column, most: int = 240) -> Column:
    """The text, or its first characters up to a word's end with an ellipsis."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.+)\s", 1)
    cut = F.regexp_replace(F.when(whole == "", head).otherwise(whole), r"\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def title_terms(title: Column) -> Column:
    each = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(each))


def tokens(text: Column) -> Column:
    """Words with only their letters and digits, lower-cased."""
    return F.filter(F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))), lambda w: w != "")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags part words."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return collapsed(bare)


def duration_seconds(text: Column) -> Column:
    """Seconds of ISO 8601, clock or plain durations; null for none or zero."""
    iso = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?$"
    part = lambda n: F.coalesce(F.regexp_extract(text, iso, n).try_cast("long"), F.lit(0))
    up = F.when(part(5) > 0, 1).otherwise(0)
    clock = F.split(text, ":")
    at = lambda k: F.coalesce(F.get(F.reverse(clock), F.lit(k)).try_cast("long"), F.lit(0))
    found = (
        F.when(text.rlike(r"^P(?=.)") & text.rlike(iso) & ~text.rlike("T$"), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4) + up)
        .when(text.rlike(r"^\d+(:[0-5]?\d){1,2}$"), at(0) + 60 * at(1) + 3600 * at(2))
        .when(text.rlike(r"^\d+(\.\d+)?$"), F.ceil(text.try_cast("double")).cast("long"))
    )
    return F.nullif(found, F.lit(0))


def byte_size(text: Column) -> Column:
    """Bytes of ``1.5 MiB``, ``2k`` and the like; null where it is none."""
    shape = r"(?i)^\s*(\d+(?:\.\d{1,6})?)\s*([kmgt]?)(i?)(b?)\s*$"
    base = F.when(F.lower(F.regexp_extract(text, shape, 3)) == "i", 1024).otherwise(1000)
    unit = F.lower(F.regexp_extract(text, shape, 2))
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    number = F.regexp_extract(text, shape, 1).try_cast("decimal(18,6)")
    return F.when(text.rlike(shape), F.round(number * F.pow(base, power).cast("decimal(13,0)"), 0).cast("long"))


#: Characters that XML reserves (fixed values).
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escaped(text: Column) -> Column:
    for raw, name in XML:
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def identity_key(text: Column) -> Column:
    """Letters and digits alone, lower-cased; null without any."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.lit(""))


def picture_text(text: Column, most: int = 300) -> Column:
    return F.nullif(F.substring(collapsed(text), 1, most), F.lit(""))


def language_tag(tag: Column) -> Column:
    """A well-formed language tag with its usual casing, else null."""
    parts = F.split(F.lower(F.trim(tag)), "[-_]")
    cased = F.transform(
        parts,
        lambda p, i: F.when(i == 0, p).when((F.length(p) == 4) & p.rlike("^[a-z]+$"), F.initcap(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p),
    )
    return F.when(F.trim(tag).rlike("^[A-Za-z]{2,8}([-_][A-Za-z0-9]{1,8})*$"), F.array_join(cased, "-"))


#: Elements that go with all they hold, and those that go as tags (fixed values).
ACTIVE = ("script", "style", "svg", "iframe", "object")
ACTIVE_TAGS = ("embed", *ACTIVE)
ACTIVE_PATTERNS = (
    "(?is)<!--.*?-->",
    *(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>" for name in ACTIVE),
    rf"(?is)</?(?:{'|'.join(ACTIVE_TAGS)})\b[^>]*>",
)
ACTIVE_ATTRIBUTES = (
    r"""(?is)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""",
    r"""(?is)\s+(?:href|src|action)\s*=\s*("\s*(?:javascript|data):[^"]*"|'\s*(?:javascript|data):[^']*'|(?:javascript|data):[^\s>]+)""",
)


def without_active(html: Column) -> Column:
    """HTML without scripts, embedded documents, comments, event attributes,
    and links that run code; attributes end at the tag's first ``>``."""
    for pattern in ACTIVE_PATTERNS:
        html = F.regexp_replace(html, pattern, "")
    pieces = F.split(html, "<")

    def clean(piece: Column) -> Column:
        tag, rest = F.regexp_extract(piece, "(?s)^[^>]*", 0), F.regexp_extract(piece, "(?s)^[^>]*(.*)$", 1)
        for pattern in ACTIVE_ATTRIBUTES:
            tag = F.regexp_replace(tag, pattern, "")
        return F.concat(tag, rest)

    return F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), clean)), "<")


def chapters(text: Column) -> Column:
    """(at, label) of the lines that begin with a clock time, in order."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(r"^\s*\(?\d{1,2}(:[0-5]\d){1,2}\)?\s+\S"))
    clock = lambda s: F.regexp_extract(s, r"(\d{1,2}(?::[0-5]\d){1,2})", 1)
    label = lambda s: F.trim(F.regexp_replace(s, r"^\s*\(?[\d:]+\)?\s+[-–—:]?\s*", ""))
    return F.transform(lines, lambda s: F.struct(clock(s).alias("at"), label(s).alias("label")))


def without_counter(text: Column) -> Column:
    """Text without a thread's ``(1/3)``, ``[1/3]`` or ``1/3`` at its end."""
    return F.regexp_replace(text, r"\s*(?:\(\d{1,3}/\d{1,3}\)|\[\d{1,3}/\d{1,3}\]|(?<=\s)\d{1,3}/\d{1,3})\s*$", "")


def first_spellings(names: Column) -> Column:
    """Names in order, each once whatever its case, as first spelt."""
    key = lambda n: F.lower(F.trim(n))
    return F.filter(names, lambda n, i: (F.trim(n) != "") & (F.array_position(F.transform(names, key), key(n)) == i + 1))


def best_picture(srcset: Column) -> Column:
    """URL of the largest ``w``, ``x`` or ``h`` of a source set; the last of equals."""
    found = F.regexp_extract_all(srcset, F.lit(r"(?:^|,)\s*(\S*[^\s,](?:\s+[0-9.]+[wxh])?)(?=\s*(?:,|$))"), F.lit(1))
    score = lambda c: F.coalesce(F.regexp_extract(c, r"\s([0-9.]+)[wxh]$", 1).try_cast("double"), F.lit(1.0))
    ranked = F.transform(found, lambda c, i: F.struct(score(c).alias("score"), i.alias("at"), F.substring_index(F.trim(c), " ", 1).alias("url")))
    return F.array_max(ranked)["url"]
