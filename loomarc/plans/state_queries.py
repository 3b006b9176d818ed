"""Runs, states, age bands, threads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ingest, lookups, state
from .registry import query, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query(
    f"""SELECT band, count(*) AS items FROM (SELECT CASE WHEN h < 1 THEN 'fresh' WHEN h < 3 THEN 'h1' WHEN h < 24 THEN 'h3' ELSE 'h24' END AS band
    FROM (SELECT greatest(epoch_us({_NOW}) - epoch_us(ts), 0) / 3600000000 AS h FROM events)) GROUP BY band"""
)
def age_bands(spark, sf):
    return table(spark, sf, "events").groupBy(dates.age_band(F.col("ts"), _now()).alias("band")).agg(F.count("*").alias("items"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS items FROM events GROUP BY 1")
def published_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("items"))


@query(
    """WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events),
    l AS (SELECT *, max(ok) OVER (PARTITION BY user_id) AS top FROM r)
    SELECT user_id, min(ts) AS since, count(*) AS failures FROM l WHERE event_type = 'error' AND ok = top GROUP BY user_id"""
)
def status_transitions(spark, sf):
    return state.error_runs(table(spark, sf, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", "ts")


@query(
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1"""
)
def seen_dedupe(spark, sf):
    first = state.reserved(table(spark, sf, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type")), "key", [F.asc("ts"), F.asc("event_id")])
    return first.where("owns").select("event_id", "user_id", "event_type")


@query(
    """SELECT event_id FROM events e WHERE e.ts >= TIMESTAMP '2024-01-15'
    AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-15' AND s.user_id = e.user_id AND s.event_type = e.event_type AND s.props = e.props)
    AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-15' AND s.user_id = e.user_id AND s.value = e.value)"""
)
def unseen_events(spark, sf):
    events = table(spark, sf, "events")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    keys = F.array(F.concat_ws("|", F.lit("props"), "user_id", "event_type", "props"), F.concat_ws("|", F.lit("value"), "user_id", "value"))
    seen = events.where(F.col("ts") < middle).select(F.explode(keys).alias("key")).distinct()
    return state.unseen(events.where(F.col("ts") >= middle), keys, seen, "event_id").select("event_id")


@query(
    """SELECT event_id FROM (SELECT event_id, sha1(props) AS h, lag(sha1(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    WHERE h IS DISTINCT FROM p"""
)
def conditional_fetch(spark, sf):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hashed = table(spark, sf, "events").withColumn("h", F.sha1("props"))
    return hashed.withColumn("p", F.lag("h").over(before)).where(~F.col("h").eqNullSafe(F.col("p"))).select("event_id")


@query(
    """SELECT user_id, misses, CASE WHEN misses <= 0 THEN 0 ELSE least(30 * pow(2.0, least(misses, 20) - 1), 10080.0)::BIGINT END AS minutes
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY user_id)"""
)
def retry_backoff(spark, sf):
    misses = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("misses"))
    return misses.withColumn("minutes", dates.retry_minutes(F.col("misses")))


_WAIT = "CASE WHEN {0}answer IS NOT NULL THEN 86400 WHEN {0}misses = 0 THEN 0 ELSE 60 * least(30 * pow(2, least({0}misses, 20) - 1), 10080)::BIGINT END"
_ASKED = f'NOT coalesce(e."at" < r.checked_at + {_WAIT.format("r.")}, false)'
_LOOKUPS = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS name, epoch_us(ts) // 1000000 AS "at", event_type AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS nth FROM events),
  r AS (SELECT DISTINCT key, 0::BIGINT AS nth, NULL::BIGINT AS name, NULL::BIGINT AS "at", false AS asked, NULL::BIGINT AS checked_at, NULL::VARCHAR AS answer, 0::BIGINT AS misses FROM e
    UNION ALL SELECT e.key, e.nth, e.name, e."at", {_ASKED},
      CASE WHEN {_ASKED} AND kind <> 'error' THEN e."at" ELSE r.checked_at END,
      CASE WHEN NOT ({_ASKED}) OR kind = 'error' THEN r.answer WHEN kind IN ('purchase', 'signup') THEN kind || e.name END,
      CASE WHEN NOT ({_ASKED}) OR kind = 'error' THEN r.misses WHEN kind IN ('purchase', 'signup') THEN 0 ELSE r.misses + 1 END
    FROM r JOIN e ON e.key = r.key AND e.nth = r.nth + 1)"""


def _requests(spark, sf):
    """Events as lookups of their user: purchases and signups would be found,
    errors find the provider unavailable, others find nothing."""
    kind = F.col("event_type")
    found = kind.isin("purchase", "signup")
    outcome = F.when(found, lookups.FOUND).when(kind == "error", lookups.UNAVAILABLE).otherwise(lookups.EMPTY)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    answer = F.when(found, F.concat(kind, F.col("event_id").cast("string")))
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("name"), at.alias("at"), outcome.alias("outcome"), answer.alias("answer"))


@query(_LOOKUPS + ' SELECT key, name, "at", asked, answer, misses FROM r WHERE nth > 0')
def served_lookups(spark, sf):
    return lookups.replayed(_requests(spark, sf))


@query(
    _LOOKUPS
    + f""", c AS (SELECT key, checked_at, answer, misses, max("at") OVER () AS now FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY nth DESC) AS k FROM r WHERE nth > 0) WHERE k = 1),
    d AS (SELECT c_custkey AS key, coalesce(misses, 0) AS misses, c_acctbal FROM customer LEFT JOIN c ON key = c_custkey
      WHERE NOT coalesce((SELECT max(now) FROM c) < checked_at + {_WAIT.format("")}, false))
    SELECT key, misses FROM d ORDER BY c_acctbal DESC, key LIMIT 64"""
)
def lookup_jobs(spark, sf):
    """The 64 customers of the highest balance whose lookup is not fresh when
    the last event has passed."""
    served = lookups.replayed(_requests(spark, sf))
    last = F.struct("at", "name")
    changed = F.max_by("at", F.when(F.col("asked") & F.col("changes"), last))
    served = served.join(_requests(spark, sf).select("name", (F.col("outcome") != lookups.UNAVAILABLE).alias("changes")), "name")
    cache = served.groupBy("key").agg(F.timestamp_seconds(changed).alias("checked_at"), F.max_by("answer", last).alias("answer"), F.max_by("misses", last).alias("misses"))
    now = served.agg(F.max("at")).first()[0] or 0
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (-F.col("c_acctbal")).alias("order"))
    return lookups.jobs(wanted, cache, ["key"], [F.col("order")], F.timestamp_seconds(F.lit(now)), 64)


@query(
    """SELECT e.event_type AS source, count(*) AS outcomes, count(*) FILTER (value IS NOT NULL) AS ok, bool_and(e.event_type = 'error') AS all_failed
    FROM events e GROUP BY 1"""
)
def run_report(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.count("*").alias("outcomes"), F.count("value").alias("ok"), F.every(F.col("event_type") == "error").alias("all_failed")
    )


@query(
    """SELECT p_partkey, policy, first_seen FROM (SELECT l_partkey AS p_partkey, l_returnflag AS policy, min(l_shipdate) AS first_seen FROM lineitem
    GROUP BY ALL) JOIN part USING (p_partkey) WHERE policy <> substr(p_brand, 1, 1)"""
)
def readmitted_keys(spark, sf):
    lines = table(spark, sf, "lineitem")
    evicted = lines.groupBy("l_partkey", "l_returnflag").agg(F.min("l_shipdate").alias("first_seen"))
    evicted = evicted.select(F.col("l_partkey").alias("source"), F.array("l_returnflag").alias("keys"), F.col("l_returnflag").alias("policy"), "first_seen")
    now = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.substring("p_brand", 1, 1).alias("policy"))
    return state.readmitted(evicted, now).select(F.col("source").alias("p_partkey"), F.col("key").alias("policy"), "first_seen")


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_role FROM conversations"""
)
def thread_preorder(spark, sf):
    """A reply answers the turn before it, so pre-order is the order of turns."""
    thread = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.row_number().over(thread) - 1).alias("depth"), F.lag("role").over(thread).alias("parent_role")
    )


@query(
    """SELECT user_id, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS outcomes,
    count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ALL"""
)
def outcome_windows(spark, sf):
    from ..streaming import outcome_counts

    counts = outcome_counts(table(spark, sf, "events"), "user_id", "event_type = 'error'")
    return counts.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "outcomes", "failures")


@query()
def ingest_plan(spark, sf):
    """Events of the second half of the time as entries of their user's feed:
    those before were seen, signups among them are archived, errors evicted."""
    events = table(spark, sf, "events").withColumn("source", F.col("user_id").cast("string"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2 if first else None
    keys = F.array(F.concat(F.lit("id:"), F.col("event_id") % 5000), F.concat_ws(":", F.lit("props"), "event_type", "props"))
    entries = events.select("event_id", "source", "ts", "event_type", F.concat_ws("-", "event_type", "props", F.col("event_id") % 40).alias("link"), keys.alias("keys"))
    old = entries.where(F.col("ts") < F.lit(middle)).withColumn("key", F.explode("keys"))
    existing = old.where("event_type = 'signup'").groupBy("source", "key").agg(F.concat(F.lit("items/"), F.min("event_id")).alias("path"))
    evicted = old.where("event_type = 'error'").select("source", "key").distinct()
    links = old.where("event_type = 'purchase'").select("link")
    made = ingest.plan(entries.where(F.col("ts") >= F.lit(middle)), old.select("source", "key").distinct(), existing, evicted, links, "event_id", "source", "ts")
    return made.select("event_id", "action", "path")
