"""Age of a posting at a given time. Ages count whole days of elapsed time, not calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _age_seconds(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 1e6


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days since ``at``; 0 for a time to come; null stays null."""
    return F.greatest(F.floor(_age_seconds(at, as_of) / 86400), F.lit(0)).cast("long") + F.lit(0) * F.unix_micros(at)


def freshness_tier(at: Column, as_of: Column) -> Column:
    d = age_days(at, as_of)
    return F.when(d < dims.FRESH_DAYS, "fresh").when(d < 21, "recent").when(d < 60, "aging").when(d < 120, "stale").when(d.isNotNull(), "ancient")


def freshness_label(at: Column, as_of: Column) -> Column:
    d = age_days(at, as_of)
    n = lambda by, unit: F.concat(F.floor(d / by).cast("string"), F.lit(unit))
    return F.when(d == 0, "today").when(d < dims.FRESH_DAYS, n(1, "d ago")).when(d < 30, n(7, "w ago")).when(d < 365, n(30, "mo ago")).when(d.isNotNull(), n(365, "y ago"))


def within_days(at: Column, as_of: Column, days: int = dims.FRESH_DAYS) -> Column:
    age = _age_seconds(at, as_of) / 86400
    return F.coalesce((age >= 0) & (age < days), F.lit(False))


def still_listed(published: Column, seen: Column, as_of: Column) -> Column:
    """Label for postings a week old or more that were seen within a week; else null."""
    posted, last = _age_seconds(published, as_of) / 86400, _age_seconds(seen, as_of) / 86400
    label = F.when(last < 1, F.lit("Still listed today")).otherwise(F.concat(F.lit("Listed "), F.floor(last).cast("string"), F.lit("d ago")))
    return F.when((posted >= 7) & (last <= 7), label)


def relative_time(at: Column, as_of: Column) -> Column:
    minutes = F.floor(_age_seconds(at, as_of) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    months = F.floor(days / 30)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m ago")).when(hours < 24, said(hours, "h ago")).when(days < 30, said(days, "d ago"))
        .when(months < 12, said(months, "mo ago")).when(minutes.isNotNull(), said(F.floor(months / 12), "y ago"))
    )


def published_at(iso: Column | None = None, epoch_ms: Column | None = None) -> Column:
    """A time from ISO text, a date or epoch milliseconds; null if it is no time."""
    parts = []
    if iso is not None:
        parts.append(F.try_to_timestamp(iso))
    if epoch_ms is not None:
        parts.append(F.timestamp_millis(epoch_ms))
    return F.coalesce(*parts)
