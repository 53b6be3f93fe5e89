"""Time expressions: lookback parsing (driver-side literal), cutoffs, ISO/epoch parsing,
freshness label. ``as_of`` is always explicit so results are reproducible."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOOKBACK_RE = re.compile(r"^(\d+)([hdwm])$")


def parse_lookback(spec: str) -> dt.timedelta:
    """'<n>h|d|w|m' (trimmed, case-insensitive, month = 30 days) -> timedelta."""
    s = spec.strip().lower()
    m = _LOOKBACK_RE.match(s)
    if not m:
        raise ValueError(f"lookback {spec!r} is not a number with h, d, w or m (24h, 7d, 2w, 1m)")
    n, unit = int(m.group(1)), m.group(2)
    return {"h": dt.timedelta(hours=n), "d": dt.timedelta(days=n),
            "w": dt.timedelta(weeks=n), "m": dt.timedelta(days=30 * n)}[unit]


def as_timestamp(value) -> Column:
    """Literal (datetime or ISO string) or column -> TIMESTAMP (UTC session)."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.to_timestamp(F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")))
    return F.to_timestamp(F.lit(str(value)))


def cutoff(as_of, lookback: str) -> Column:
    delta = parse_lookback(lookback)
    micros = int(delta.total_seconds()) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.unix_micros(as_timestamp(as_of)) - F.lit(micros))


def parse_iso(col) -> Column:
    """ISO-8601 with optional trailing Z or offset -> TIMESTAMP; bad input -> null."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(c, "Z$", "+00:00")
    fmts = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
            "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS",
            "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts])


def from_epoch_millis(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_millis(c.cast("bigint"))


def age_micros(posted, as_of) -> Column:
    p = F.col(posted) if isinstance(posted, str) else posted
    return F.unix_micros(as_timestamp(as_of)) - F.unix_micros(p.cast("timestamp"))


# Freshness labels, newest first.
FRESHNESS_LABELS = ["🔥 New (today)", "✨ Fresh (< 3 days)", "📅 This week",
                    "📆 This month", "📦 Older"]
FRESHNESS_UNKNOWN = "❓ Unknown"


def freshness_label(posted, as_of) -> Column:
    """null -> Unknown; age <24h, <3d, <7d, <30d, else Older (future counts as new)."""
    p = F.col(posted) if isinstance(posted, str) else posted
    age = age_micros(p, as_of)
    day = 86_400 * 1_000_000
    return (F.when(p.isNull(), F.lit(FRESHNESS_UNKNOWN))
            .when(age < F.lit(day), F.lit(FRESHNESS_LABELS[0]))
            .when(age < F.lit(3 * day), F.lit(FRESHNESS_LABELS[1]))
            .when(age < F.lit(7 * day), F.lit(FRESHNESS_LABELS[2]))
            .when(age < F.lit(30 * day), F.lit(FRESHNESS_LABELS[3]))
            .otherwise(F.lit(FRESHNESS_LABELS[4])))


def recency_score(posted, as_of, max_age_days: int = 30) -> Column:
    """null .5; age<=0 -> 1; age>=max -> 0; else 1 - sqrt(age_days/max)."""
    p = F.col(posted) if isinstance(posted, str) else posted
    age_days = age_micros(p, as_of).cast("double") / F.lit(86_400e6)
    return (F.when(p.isNull(), F.lit(0.5)).when(age_days <= 0, F.lit(1.0))
            .when(age_days >= max_age_days, F.lit(0.0))
            .otherwise(F.lit(1.0) - F.sqrt(age_days / F.lit(float(max_age_days)))))
