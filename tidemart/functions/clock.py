"""Epoch and text time to Spark time, and back to the text the summaries carry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_MS = 24 * 60 * 60 * 1000


def from_ms(ms: Column) -> Column:
    """Epoch milliseconds to timestamp."""
    return F.timestamp_millis(ms)


def from_ms_by_second(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp cut to the second."""
    return F.timestamp_seconds(F.floor(ms / F.lit(1000)))


def from_seconds_text(seconds: Column) -> Column:
    """Epoch seconds carried as text; text that is no number gives null."""
    return F.timestamp_seconds(seconds.try_cast("bigint"))


def day_of_ms(ms: Column) -> Column:
    """Calendar date, in the session zone, of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(ms))


def day_text(text: Column) -> Column:
    """`yyyy-MM-dd` of a date-time text; anything unreadable gives null."""
    return text.try_cast("timestamp_ntz").cast("date").cast("string")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, SECOND_FORMAT)
