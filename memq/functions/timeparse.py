"""Dated text such as ``2023/04/10 (Mon) 23:07``, minute precision, read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stamp(c: Column) -> Column:
    plain = F.regexp_replace(c, r" \([A-Za-z]{3}\) ", " ")
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2} \([A-Za-z]{3}\) \d{1,2}:\d{1,2}$"), plain), F.lit("y/M/d H:m"))


def try_epoch(c: Column | str) -> Column:
    """Epoch seconds; null where the format is another, the day does not exist or the weekday does not agree."""
    c = _c(c)
    t = _stamp(c)
    return F.when(F.date_format(t, "EEE") == F.regexp_extract(c, r"\(([A-Za-z]{3})\)", 1), F.unix_timestamp(t))


def epoch(c: Column | str) -> Column:
    """Epoch seconds; fails on a text that try_epoch() would give null for, null included."""
    c = _c(c)
    return F.coalesce(try_epoch(c), F.raise_error(F.concat(F.lit("not a dated text: "), F.coalesce(c, F.lit("null")))).cast("bigint"))


def human_date(ts: Column | str) -> Column:
    """``2023-04-10 (Mon)``; ``unknown`` for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(_c(ts)), "yyyy-MM-dd (EEE)"), F.lit("unknown"))


def day(ts: Column | str, missing: str = "unknown") -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(_c(ts)), "yyyy-MM-dd"), F.lit(missing))


def minute(ts: Column | str) -> Column:
    """``<ts>  (YYYY-MM-DD HH:MM)``."""
    ts = _c(ts)
    return F.concat(ts.cast("string"), F.lit("  ("), F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"), F.lit(")"))


def tolerance_label(seconds: Column | str) -> Column:
    """``strict``, ``+6h``, ``+7d``: whole days from one day on, else hours."""
    s = _c(seconds)
    days = F.concat(F.lit("+"), F.floor(s / 86_400).cast("string"), F.lit("d"))
    hours = F.concat(F.lit("+"), F.floor(s / 3_600).cast("string"), F.lit("h"))
    return F.when(s == 0, "strict").when(s % 86_400 == 0, days).otherwise(hours)
