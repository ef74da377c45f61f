"""Time buckets as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Frequency codes and the calendar unit each stands for.
FREQUENCY_UNITS = {
    "h": "hour",
    "H": "hour",
    "D": "day",
    "W": "week",
    "M": "month",
    "ME": "month",
    "MS": "month",
    "Q": "quarter",
    "QE": "quarter",
    "QS": "quarter",
    "Y": "year",
    "YE": "year",
    "YS": "year",
}
_UNITS = ("hour", "day", "week", "month", "quarter", "year")
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def grain_for(year: int | None, month: int | None) -> str:
    """Bucket size that suits the filters: all time by year, a year by month, a month by day."""
    if year is None:
        return "year"
    return "month" if month is None else "day"


def parse_frequency(freq: str) -> tuple[int, str]:
    """Split ``"2D"``, ``"M"`` or ``"month"`` into a multiple and a unit."""
    if freq in _UNITS:
        return 1, freq
    match = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
    if not match or match.group(2) not in FREQUENCY_UNITS:
        raise ValueError(f"unknown resample frequency: {freq!r}")
    count = int(match.group(1) or 1)
    if count < 1:
        raise ValueError(f"unknown resample frequency: {freq!r}")
    return count, FREQUENCY_UNITS[match.group(2)]


def bucket(ts: Column | str, freq: str) -> Column:
    """Start of the bucket holding ``ts``, without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    count, unit = parse_frequency(freq)
    if count == 1:
        # Truncation goes by way of the session's zone, where an hour can be missing or double.
        zone = F.current_timezone().isin("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
        wrong = F.raise_error(F.lit("buckets need spark.sql.session.timeZone=UTC")).cast("timestamp_ntz")
        made = F.date_trunc(unit, ts).cast("timestamp_ntz")
        return F.when(zone, made).otherwise(wrong) if unit == "hour" else made
    if unit in _MONTHS:
        width = count * _MONTHS[unit]
        index = F.year(ts) * 12 + F.month(ts) - 1
        first = index - index % width
        start = F.make_date((first / 12).cast("int"), first % 12 + 1, F.lit(1))
        return start.cast("timestamp_ntz")
    return F.window(ts, f"{count} {unit}s").getField("start").cast("timestamp_ntz")


def step(freq: str) -> Column:
    """Distance from one bucket start to the next."""
    count, unit = parse_frequency(freq)
    if unit in _MONTHS:
        return F.expr(f"INTERVAL {count * _MONTHS[unit]} MONTHS")
    return F.expr(f"INTERVAL {count} {unit.upper()}S")


def bucket_label(start: Column | str, freq: str, label: str = "start") -> Column:
    """Day that names a bucket: its first day, or its last when ``label="end"``."""
    start = F.col(start) if isinstance(start, str) else start
    if label == "start":
        return start
    if label != "end":
        raise ValueError(f"label must be 'start' or 'end', not {label!r}")
    _, unit = parse_frequency(freq)
    if unit == "hour":
        return start
    return (start + step(freq) - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")


def text_label(ts: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(ts, pattern)


def calendar_fields(ts: Column | str) -> dict[str, Column]:
    return {
        "tahun": F.year(ts).cast("long"),
        "bulan": F.month(ts).cast("long"),
        "tanggal": F.to_date(ts),
    }


def weekday(ts: Column | str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)
