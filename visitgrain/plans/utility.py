"""Freshness and filter options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.operators import aggregate as agg
from visitgrain.operators.filters import latest_frame


def last_update(v: DataFrame) -> DataFrame:
    """Latest event time as text; no row for an empty table."""
    latest = latest_frame(v).filter(F.col("latest").isNotNull())
    return latest.select(F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("waktu_registrasi_terakhir"))


def _option(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("option"), value.cast("string").alias("value"))


def filter_options(v: DataFrame, *, observed: bool = False) -> DataFrame:
    """(option, value) rows: districts, years and months to offer.

    Years are the whole range and months 1 to 12, or with ``observed`` only those with visits.
    """
    districts = agg.distinct_values(v, "kabupaten").select(_option("kabupaten", F.col("kabupaten")).alias("o"))
    if observed:
        seen = agg.observed_calendar(v)
        both = F.array(_option("tahun", F.col("tahun")), _option("bulan", F.col("bulan")))
        calendar = seen.select(F.explode(both).alias("o")).distinct()
    else:
        years = F.transform(F.sequence("first", "last"), lambda y: _option("tahun", y))
        months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: _option("bulan", m))
        span = agg.year_span(v).filter(F.col("first").isNotNull())
        calendar = span.select(F.explode(F.concat(years, months)).alias("o"))
    return districts.unionByName(calendar).select("o.*")
