"""Date expressions; the clock is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_time(published: Column, updated: Column, first_seen: Column) -> Column:
    return F.coalesce(published, updated, first_seen)


def age_hours(at: Column, now: Column) -> Column:
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(seconds, F.lit(0)) / F.lit(3_600_000_000)


def age_band(at: Column, now: Column) -> Column:
    """fresh below an hour, h1 below three, h3 below a day, h24 from then on."""
    hours = age_hours(at, now)
    return F.when(hours < 1, "fresh").when(hours < 3, "h1").when(hours < 24, "h3").otherwise("h24")


def cutoff(now: Column, max_age_days: Column, since: Column) -> Column:
    """The later of the age limit and the date; zero days is no limit."""
    aged = F.when(max_age_days > 0, now.cast("timestamp_ntz") - F.make_interval(days=max_age_days))
    return F.greatest(aged, since.cast("timestamp_ntz"))


def retry_minutes(misses: Column) -> Column:
    """Half an hour, doubled with each miss, at most a week."""
    return F.when(misses <= 0, 0).otherwise(F.least(30 * F.pow(2.0, F.least(misses, F.lit(20)) - 1), F.lit(10080.0))).cast("long")


def relative_text(at: Column, now: Column) -> Column:
    """just now, then minutes, hours, days below 45, months below 18, years."""
    seconds = F.floor(age_hours(at, now) * 3600 + 0.5).cast("long")
    days = F.floor(seconds / 86400)
    told = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, told(seconds / 60, "m"))
        .when(seconds < 86400, told(seconds / 3600, "h"))
        .when(days < 45, told(days, "d"))
        .when(F.floor(days / 30) < 18, told(days / 30, "mo"))
        .otherwise(told(days / 365, "y"))
    )


def sweep_due(marker: Column, now: Column) -> Column:
    """True without a mark of the last sweep, or with one a day old or in the future."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(marker.cast("timestamp"))) / 1_000_000
    return F.coalesce((seconds < 0) | (seconds >= 86400), F.lit(True))


#: Forms of written dates, the day before the month where both fit (fixed values).
WRITTEN = ("yyyy-MM-dd", "yyyy/M/d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")


def written_date(text: Column) -> Column:
    """The date that a text is; null for any other text."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1"), r"\s+", " ")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(form)) for form in WRITTEN)).cast("date")
