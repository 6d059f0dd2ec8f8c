"""Times as text: UTC, seconds; nothing reads the clock, ``now`` is always given."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO text, null where it can't be read; no zone means UTC."""
    zoned = F.trim(text).rlike(r"(?i)(Z|UTC|[+-]\d{2}(:?\d{2})?)$") & text.contains(":")
    return F.when(zoned, F.trim(text)).otherwise(F.concat(F.trim(text), F.when(text.contains(":"), "Z").otherwise("T00:00:00Z"))).try_cast("timestamp")


def older_than(text: Column, now: Column, days: int) -> Column:
    """Strictly older than ``days`` days; unreadable or null times are not."""
    return F.coalesce(parse_iso(text) < now - F.make_dt_interval(F.lit(days)), F.lit(False))


def stamp(now: datetime) -> str:
    """Compact UTC stamp of a driver-side time; a naive one is UTC."""
    return (now if now.tzinfo else now.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
