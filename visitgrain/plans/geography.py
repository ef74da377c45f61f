"""Visits per district."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from visitgrain.operators import aggregate as agg, reshape
from visitgrain.operators.filters import equals, in_year
from visitgrain.plans.common import period, scoped, series
from visitgrain.schema import EVENT_TIME, HOME_PROVINCE

DEFAULT_SERIES_YEAR = 2021


def per_district(v: DataFrame, *, province: str | None = None, **filters) -> DataFrame:
    """Visits per district; the unknown (null) district counts 0."""
    rows, _ = scoped(v, **filters)
    return agg.count_non_null_by(equals(rows, provinsi=province), "kabupaten")


def per_district_daily(
    v: DataFrame,
    *,
    year: int = DEFAULT_SERIES_YEAR,
    month: int | None = None,
    province: str | None = HOME_PROVINCE,
    values: Sequence[str] | None = None,
    dense: bool = True,
) -> DataFrame:
    """Daily visits, one column per district of the province."""
    rows = equals(in_year(v, EVENT_TIME, year, month), provinsi=province)
    wide = reshape.pivot_count(rows, [period("day")], "kabupaten", values, fill=True)
    return series(wide, "day", dense=dense)
