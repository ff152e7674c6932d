"""Time functions. Sessions run in UTC, so naive times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, 0 at least."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9)


def hour_key(ts: Column) -> Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd-HH")


def parsed_hour_key(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit("yyyy-MM-dd-HH"))


def parsed_iso(c: Column) -> Column:
    """ISO-8601 with Z or an offset; null if it can't be read."""
    return F.try_to_timestamp(c)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def url_date(url: Column) -> Column:
    """The date in a URL: /2024-01-31/, /2024/01/31/ or /20240131; null if there is no real one."""
    digits = F.regexp_replace(F.regexp_extract(url, r"/(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})(?!\d)", 1), "[-/]", "")
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))


def age_days(day: Column, today: Column) -> Column:
    """Days since a date given as text; a malformed one counts as today."""
    return F.datediff(today, F.coalesce(F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))), today))


def elapsed(since: Column, now: Column, seconds: Column) -> Column:
    """Whether ``seconds`` have passed since a time; true if there is none."""
    return since.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(since) >= seconds)
