"""Shared pieces of the dashboard queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from visitgrain.functions.dates import bucket, grain_for
from visitgrain.operators.filters import base_filter, latest_month
from visitgrain.operators.resample import PERIOD, densify, labelled
from visitgrain.schema import EVENT_TIME

Recent = Callable[[DataFrame, DataFrame], DataFrame]


def scoped(
    v: DataFrame,
    *,
    year: int | None = None,
    month: int | None = None,
    district: str | None = None,
    reg_type: str | None = None,
    recent: Recent | None = None,
) -> tuple[DataFrame, str]:
    """Filtered rows and the bucket size that suits them.

    ``recent(filtered, whole)`` replaces the missing year filter by a recent range with daily
    buckets; its anchor is the latest time of the whole table, not of the filtered rows.
    """
    rows = base_filter(v, year=year, month=month, district=district, reg_type=reg_type)
    if year is None and recent is not None:
        return recent(rows, v), "day"
    return rows, grain_for(year, month)


def year_or_latest_month(v: DataFrame, **filters) -> DataFrame:
    """Rows of the given year (and month), or of the latest month in the data."""
    rows = base_filter(v, **filters)
    return rows if filters.get("year") is not None else latest_month(rows, EVENT_TIME, anchor=v)


def series(
    agg: DataFrame,
    freq: str,
    *,
    dense: bool = False,
    label: str = "start",
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregated buckets as a labelled, ordered series; ``dense`` adds the empty buckets."""
    if dense:
        agg = densify(agg, freq, measures or [c for c in agg.columns if c != PERIOD])
    return labelled(agg, freq, label)


def period(freq: str, ts: str = EVENT_TIME) -> Column:
    return bucket(ts, freq).alias(PERIOD)
