"""Scalar functions on columns: spans of time, names of times, missing values, ordered replacement."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated."""
    return F.timestamp_diff("SECOND", start, end)


def span_milliseconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def span_days(start: Column, end: Column) -> Column:
    """Days as a fraction of whole seconds."""
    return span_seconds(start, end) / 86400.0


def sql_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def file_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM_dd__HH_mm_ss")


def header_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def readable(seconds: Column) -> Column:
    """``1h 01m 01s``."""
    s = seconds.cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def nan_to_neg(value: Column) -> Column:
    """-1 for NaN and null."""
    return F.coalesce(F.nanvl(value, F.lit(-1.0)), F.lit(-1.0))


def replace_ordered(text: Column, table: dict[str, str]) -> Column:
    """Every pattern of ``table`` replaced by its value, the longest pattern first."""
    for pattern in sorted(table, key=len, reverse=True):
        text = F.regexp_replace(text, pattern, table[pattern])
    return text


def check_windows(windows: list[int], least: int = -18) -> list[int]:
    """Sampling windows must lie in [least, 0]."""
    if windows and (min(windows) < least or max(windows) > 0):
        raise RuntimeError(f"sampling windows must lie in [{least}, 0]")
    return windows


def now_seconds() -> str:
    return datetime.datetime.now().strftime("%Y_%m_%d__%H_%M_%S")


def now_microseconds() -> str:
    return datetime.datetime.now().strftime("%Y_%m_%d__%H_%M_%S_%f")


def clean_name(text: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^\w.-]+", "_", text)
