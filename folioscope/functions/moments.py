"""Instants, ages and calendar rules as column expressions (UTC session time zone assumed)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
PRODUCT_ZONE = "Asia/Shanghai"
OFF_PEAK_START = "18:30:00.000000"
OFF_PEAK_END = "08:30:00.000000"
UNDATED_WEIGHT = 0.35
OLDEST_WEIGHT = 0.1
FRESH_DAYS = 14
# -------------------------------------------------------------------------------------------

AWARE = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def instant(value: str | datetime | Column) -> Column:
    """A UTC instant from a literal or a column; naive Python values are refused."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("instants must carry a time zone")
        value = value.astimezone(timezone.utc).isoformat()
    elif not value.upper().endswith("Z") and "+" not in value[10:] and "-" not in value[10:]:
        raise ValueError("instants must carry a time zone")
    return F.lit(value).cast("timestamp")


def parse_instant(text: Column) -> Column:
    """Text to an instant, NULL where it carries no offset or does not parse."""
    return F.when(text.rlike(AWARE), F.try_to_timestamp(text))


def days_between(later: Column, earlier: Column) -> Column:
    """Signed days with microsecond precision."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def freshness(now: Column, published: Column, days: int = FRESH_DAYS) -> Column:
    """1 at publication, falling to 0 after ``days``; future papers count as new."""
    age = F.greatest(days_between(now, published), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 - age / days)


def date_decay(date_text: Column, observed: Column | None) -> Column:
    """Recency weight of a loosely written date (D3)."""
    if observed is None:
        return F.lit(1.0)
    pattern = r"(?U)\b((?:19|20)\d{2})(?:-(\d{2})(?:-(\d{2}))?)?\b"
    text = F.coalesce(date_text, F.lit(""))
    part = lambda i: F.regexp_extract(text, pattern, i)
    or_one = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("01"))
    day = F.try_to_timestamp(
        F.concat_ws("-", part(1), or_one(part(2)), or_one(part(3))), F.lit("yyyy-MM-dd")
    )
    age = F.greatest(days_between(observed, day), F.lit(0.0))
    return F.when(
        (part(1) == "") | day.isNull(), F.lit(UNDATED_WEIGHT)
    ).otherwise(F.greatest(F.lit(OLDEST_WEIGHT), F.exp(-age / 365)))


def first_year(date_text: Column) -> Column:
    """First four-digit year of a date text."""
    year = F.regexp_extract(F.coalesce(date_text, F.lit("")), r"(?U)\b(?:19|20)\d{2}\b", 0)
    return F.nullif(year, F.lit("")).cast("int")


def product_date(at: Column) -> Column:
    """Calendar date shown to readers."""
    return F.date_format(F.from_utc_timestamp(at, PRODUCT_ZONE), "yyyy-MM-dd")


def generation_window_open(at: Column) -> Column:
    """True in the off-peak hours, both ends included."""
    clock = F.date_format(F.from_utc_timestamp(at, PRODUCT_ZONE), "HH:mm:ss.SSSSSS")
    return (clock >= OFF_PEAK_START) | (clock <= OFF_PEAK_END)


def generation_decision(at: Column, event_name: Column, allow_peak: bool = False) -> Column:
    """What a run at this instant may do."""
    return (
        F.when(generation_window_open(at) | F.lit(allow_peak), "allowed")
        .when(event_name == "schedule", "scheduled-skip")
        .otherwise("manual-blocked")
    )


def days_before(at: Column, days: int) -> Column:
    return at - F.expr(f"INTERVAL {int(days)} DAYS")


def day_key(at: Column) -> Column:
    """UTC calendar day, for evidence kept once per day."""
    return F.date_format(at, "yyyy-MM-dd")
