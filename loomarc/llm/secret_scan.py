"""Secret scans that link the parts of a credential.

Strong finds stand alone: an assignment to a secret's name, an access
identifier, a long run of hex.  Weak ones say little by themselves: a random-
looking key, a user name, an address of a service.  They are reported only
where a complementary part lies within ``reach`` code points of the same
document, found by an interval join that sweeps each document's spans in order.

Built-in functions give matches but not their places; a place follows from
the lengths of all matches and of the text between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Kinds in their order, with patterns; a "+" kind also checks what it found.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more: runs are taken whole
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 characters or more
KEY = r"[A-Za-z0-9+/_-]{32,}"
USER = r"""(?i:user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{2,}"""
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[^\s"'<>]{3,}"""

KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
BASE = KINDS[:3]
#: For each weak kind the kinds that complete it.
COMPLETES = {"key": ("access", "endpoint"), "user": ("assign", "key"), "endpoint": ("assign", "access", "key")}


@dataclass(frozen=True)
class SecretScan:
    reach: int = 256


def _lengths(text: Column, pattern: str, told: Column) -> Column:
    """(length before, length of, whether told) of each match, in order."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), told.alias("t")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["t"].alias("told")),
    )


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.lit(True))


def secret_spans(docs: DataFrame, rule: SecretScan = SecretScan()) -> tuple[DataFrame, DataFrame]:
    """(files, spans): key and doc_id of each row, and for each key the spans
    found: kind, start, end in code points."""
    text = F.col("text")
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | low.contains(word)
    assigns = named & (text.contains(":") | text.contains("="))
    access, address = text.contains("AKIA"), text.contains("://")
    users = (text.contains(":") | text.contains("=")) & (low.contains("user") | low.contains("login") | low.contains("account"))
    strong = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    mixed = F.transform(
        F.regexp_extract_all(text, F.lit(KEY), F.lit(0)),
        lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"),
    )
    found = docs.select(
        F.xxhash64("doc_id", "text").alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
    ).select(
        "key",
        "doc_id",
        F.when(assigns, _lengths(text, ASSIGN, strong)).alias("assign"),
        F.when(access, _lengths(text, ACCESS, _all(text, ACCESS))).alias("access"),
        F.when(text.rlike("[0-9a-f]{24}"), _lengths(text, HEX, _all(text, HEX))).alias("hex"),
        # Keys are linked to access ids and endpoints, and users to keys.
        F.when(access | address | users, _lengths(text, KEY, mixed)).alias("key_"),
        F.when(users, _lengths(text, USER, _all(text, USER))).alias("user"),
        F.when(address, _lengths(text, ENDPOINT, _all(text, ENDPOINT))).alias("endpoint"),
    )
    found = staged(found, "secrets")
    kinds = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.col("key_" if k == "key" else k))])
    rows = (
        found.where(" or ".join(f"size({'key_' if k == 'key' else k}) > 0" for k in KINDS))
        .dropDuplicates(["key"])
        .select("key", F.explode(kinds).alias("kind", "matches"))
        .select("key", "kind", F.posexplode("matches").alias("i", "m"))
        .select("key", "kind", "i", "m.*")
    )
    run = Window.partitionBy("key", "kind").orderBy("i")
    spans = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run).cast("long"))
        .where("told")
        .select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    spans = staged(spans, "spans")
    strong_spans = spans.where(F.col("kind").isin(*BASE))
    # The interval join: a weak span asks, at the last place a part may start,
    # for the furthest end of the parts that start up to there.
    others = F.create_map(*[x for k, o in COMPLETES.items() for x in (F.lit(k), F.array(*map(F.lit, o)))])
    parts = spans.select("key", F.col("kind").alias("other"), F.col("start").alias("at"), F.lit(0).alias("asks"), "kind", "start", "end")
    asked = spans.where(~F.col("kind").isin(*BASE)).select(
        "key", F.explode(others[F.col("kind")]).alias("other"), (F.col("end") + rule.reach).alias("at"), F.lit(1).alias("asks"), "kind", "start", "end"
    )
    sweep = Window.partitionBy("key", "other").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = parts.unionByName(asked).withColumn("furthest", F.max(F.when(F.col("asks") == 0, F.col("end"))).over(sweep))
    near = (F.col("asks") == 1) & (F.col("start") - F.col("furthest") <= rule.reach)
    linked = met.where(near).select("key", "kind", "start", "end").distinct()
    # A weak find that a strong one already covers adds nothing.
    cover = strong_spans.select("key", F.col("start").alias("s"), F.col("end").alias("e"))
    linked = linked.join(cover, (linked["key"] == cover["key"]) & (linked["start"] >= cover["s"]) & (linked["end"] <= cover["e"]), "left_anti")
    return found.select("key", "doc_id"), strong_spans.unionByName(linked)


def secret_scan(docs: DataFrame, rule: SecretScan = SecretScan()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; repeated rows each get a row; other
    columns are ignored; no rows give no rows.
    """
    files, spans = secret_spans(docs, rule)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("nth"), F.concat_ws(":", "kind", "start", "end").alias("said"), F.col("kind").isin(*BASE).alias("base"))
    text = lambda items: F.array_join(F.transform(items, lambda x: x["said"]), ",")
    by_key = spans.groupBy("key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list(item)).alias("items")
    )
    return files.join(by_key, "key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(text(F.filter("items", lambda x: x["base"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(text(F.col("items")), F.lit("")).alias("spans"),
    )
