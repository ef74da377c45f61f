"""Row filters.

Time filters are written as half-open ranges on the raw column so that they reach the Parquet
scan, and name the partition columns as well wherever the frame carries them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.functions.predicates import all_of, column_predicates, ntz, year_bounds
from visitgrain.schema import EVENT_TIME, PARTITION_MONTH, PARTITION_YEAR, PARTITIONS
from visitgrain.sources.summary import LAST, summary_of

# Names of relative ranges.
RELATIVE_RANGES = {
    "day": "1 DAY",
    "week": "7 DAYS",
    "month": "1 MONTH",
    "3month": "3 MONTHS",
    "6month": "6 MONTHS",
    "year": "1 YEAR",
}


def _partitioned(df: DataFrame, ts: str) -> bool:
    return ts == EVENT_TIME and set(PARTITIONS) <= set(df.columns)


def _partition_start() -> Column:
    return F.make_date(F.col(PARTITION_YEAR), F.col(PARTITION_MONTH), F.lit(1))


def in_year(df: DataFrame, ts: str, year: int, month: int | None = None) -> DataFrame:
    low, high = year_bounds(year, month)
    keep = [F.col(ts) >= ntz(low), F.col(ts) < ntz(high)]
    if _partitioned(df, ts):
        keep.append(F.col(PARTITION_YEAR) == year)
        if month is not None:
            keep.append(F.col(PARTITION_MONTH) == month)
    return df.filter(all_of(keep))


def in_month(df: DataFrame, ts: str, month: int) -> DataFrame:
    """That calendar month of every year."""
    keep = [F.month(ts) == month]
    if _partitioned(df, ts):
        keep.append(F.col(PARTITION_MONTH) == month)
    return df.filter(all_of(keep))


def between(df: DataFrame, ts: str, start: Any, end: Any) -> DataFrame:
    """Both ends included."""
    keep = [F.col(ts) >= ntz(start), F.col(ts) <= ntz(end)]
    if _partitioned(df, ts):
        keep.append(_partition_start() >= F.trunc(ntz(start), "MM"))
        keep.append(_partition_start() <= F.to_date(ntz(end)))
    return df.filter(all_of(keep))


def latest_frame(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    """One row, one column ``latest``: the greatest event time.

    A whole stored table is answered from its summary. Of any other frame with the partition
    columns only the newest month that has rows is read, once it is found without a data column.
    """
    months = summary_of(df) if ts == EVENT_TIME else None
    if months is not None:
        return months.agg(F.max(LAST).alias("latest"))
    if _partitioned(df, ts):
        newest = df.agg(F.max(_partition_start())).scalar()
        df = df.filter(_partition_start() == newest)
    return df.agg(F.max(ts).alias("latest"))


def since(
    df: DataFrame,
    ts: str,
    bound: Callable[[Column], Column],
    anchor: DataFrame | None = None,
) -> DataFrame:
    """Rows at or after ``bound(latest)``, the latest time being read from ``anchor``.

    ``anchor`` is usually the unfiltered table while ``df`` is a filtered view of it. The bound
    is a scalar subquery: it is computed once and pruned on at run time, without a join.
    """
    source = df if anchor is None else anchor
    low = latest_frame(source, ts).select(bound(F.col("latest")).cast("timestamp_ntz")).scalar()
    return from_time(df, ts, low)


def from_time(df: DataFrame, ts: str, low: Column, included: bool = True) -> DataFrame:
    """Rows at or after ``low`` (a literal or a scalar subquery), or strictly after it."""
    keep = [F.col(ts) >= low if included else F.col(ts) > low]
    if _partitioned(df, ts):
        # The same expression again: a subquery shared with the line above runs once.
        keep.append(_partition_start() >= F.trunc(low, "MM"))
    return df.filter(all_of(keep))


def last(df: DataFrame, ts: str, span: str, anchor: DataFrame | None = None) -> DataFrame:
    """``span`` back from the latest event time, such as ``"6 MONTHS"``."""
    return since(df, ts, lambda t: t - F.expr(f"INTERVAL {span}"), anchor)


def last_from_day(df: DataFrame, ts: str, span: str, anchor: DataFrame | None = None) -> DataFrame:
    """``span`` back from the start of the latest day."""
    return since(df, ts, lambda t: F.to_date(t).cast("timestamp_ntz") - F.expr(f"INTERVAL {span}"), anchor)


def last_days_whole(df: DataFrame, ts: str, days: int, anchor: DataFrame | None = None) -> DataFrame:
    """From the start of the day ``days`` before the latest event time."""
    return since(df, ts, lambda t: F.to_date(t - F.expr(f"INTERVAL {days} DAYS")), anchor)


def latest_month(df: DataFrame, ts: str, anchor: DataFrame | None = None) -> DataFrame:
    """The calendar month of the latest event time. Nothing is later, so no upper bound."""
    return since(df, ts, lambda t: F.trunc(t, "MM"), anchor)


def last_before(df: DataFrame, ts: str, span: str, as_of: Any = None) -> DataFrame:
    """``span`` back from today, or from ``as_of``."""
    now = F.current_date() if as_of is None else F.to_date(ntz(as_of))
    return from_time(df, ts, now.cast("timestamp_ntz") - F.expr(f"INTERVAL {span}"))


def equals(df: DataFrame, **values: Any) -> DataFrame:
    """Equality on each named column whose value is not None."""
    return df.filter(all_of([F.col(k) == v for k, v in values.items() if v is not None]))


def base_filter(
    df: DataFrame,
    *,
    year: int | None = None,
    month: int | None = None,
    district: str | None = None,
    reg_type: str | None = None,
    ts: str = EVENT_TIME,
) -> DataFrame:
    """The filters every dashboard query accepts. A month without a year is ignored."""
    out = equals(df, kabupaten=district, jenis_registrasi=reg_type)
    return out if year is None else in_year(out, ts, year, month)


def time_filter(
    df: DataFrame,
    ts: str,
    *,
    year: int | None = None,
    month: int | None = None,
    relative: str | None = None,
    start: Any = None,
    end: Any = None,
    anchor: DataFrame | None = None,
) -> DataFrame:
    """First match wins: year (and month), relative range, explicit range, no filter."""
    if relative is not None and relative not in RELATIVE_RANGES:
        raise ValueError(f"relative must be one of {sorted(RELATIVE_RANGES)}, not {relative!r}")
    if year is not None:
        return in_year(df, ts, year, month)
    if relative is not None:
        return last(df, ts, RELATIVE_RANGES[relative], anchor)
    if start is not None and end is not None:
        return between(df, ts, start, end)
    return df


def where(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """Column rules in the predicate dictionary form of ``functions.predicates``."""
    return df.filter(column_predicates(filters)) if filters else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows holding any null; used on aggregates."""
    return df.na.drop()
