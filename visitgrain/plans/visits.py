"""Visit counts: growth, referral, age, registration type, clinics, diagnoses, departments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitgrain.operators import aggregate as agg, rank, reshape
from visitgrain.operators.filters import drop_incomplete, equals, last_days_whole, last_from_day
from visitgrain.operators.resample import PERIOD
from visitgrain.plans.common import period, scoped, series, year_or_latest_month
from visitgrain.schema import EVENT_TIME, OUTPATIENT


def growth(v: DataFrame, *, dense: bool = False, label: str = "start", **filters) -> DataFrame:
    """Visits over time; without a year, daily over the last six months."""
    rows, freq = scoped(
        v, recent=lambda d, whole: last_from_day(d, EVENT_TIME, "6 MONTHS", whole), **filters
    )
    counted = agg.count_by(rows, period(freq), out="jumlah_kunjungan")
    return series(counted, freq, dense=dense, label=label)


def growth_per_year(v: DataFrame, *, dense: bool = False, label: str = "start") -> DataFrame:
    counted = agg.count_by(v, period("year"), out="jumlah_kunjungan")
    return series(counted, "year", dense=dense, label=label)


def _over_time(v, cat, values, dense, label, fill, recent=None, **filters) -> DataFrame:
    rows, freq = scoped(v, recent=recent, **filters)
    wide = reshape.pivot_count(rows, [period(freq)], cat, values, fill)
    return series(wide, freq, dense=dense, label=label)


def by_referral(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    return _over_time(v, "rujukan", values, dense, label, False, **filters)


def by_age(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    return _over_time(v, "kategori_usia", values, dense, label, False, **filters)


def _last_180_days(d: DataFrame, whole: DataFrame) -> DataFrame:
    return last_days_whole(d, EVENT_TIME, 180, whole)


def by_registration_type(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    """Zero-filled; without a year, daily over the last 180 days."""
    return _over_time(
        v, "jenis_registrasi", values, dense, label, True, recent=_last_180_days, **filters
    )


def registration_type_history(v: DataFrame, **filters) -> DataFrame:
    """The same series in long form (series_key, time_period, value), for forecasting."""
    rows, freq = scoped(v, recent=_last_180_days, **filters)
    counted = agg.count_by(rows, period(freq), F.col("jenis_registrasi").alias("series_key"), out="value")
    return counted.withColumn("value", F.col("value").cast("double"))


def per_registration_type(v: DataFrame, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.count_by(rows, "jenis_registrasi")


def top_clinics(v: DataFrame, *, k: int = 10, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    counted = agg.count_by(equals(rows, jenis_registrasi=OUTPATIENT), "nama_departemen")
    return rank.top_k(counted, "count", ["nama_departemen"], k)


def top_diagnoses(v: DataFrame, *, k: int = 10, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return rank.top_k(agg.count_by(rows, "diagnosa_primer"), "count", ["diagnosa_primer"], k)


def distinct_visits(v: DataFrame, *, rsd: float | None = None, **filters) -> DataFrame:
    """Distinct registration numbers of a year, or of the latest month."""
    return agg.distinct_count(year_or_latest_month(v, **filters), "no_registrasi", rsd=rsd)


def per_payer(v: DataFrame, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.count_by(rows, "jenis_penjamin")


def registration_by_referral(v: DataFrame, **filters) -> DataFrame:
    """Per registration type an array of (referral, visits) records."""
    rows, _ = scoped(v, **filters)
    return agg.nested_records(rows, "jenis_registrasi", "rujukan")


def diagnoses_of(v: DataFrame, reg_type: str, **filters) -> DataFrame:
    """Diagnoses of one registration type, most frequent first."""
    rows, _ = scoped(v, reg_type=reg_type, **filters)
    counted = drop_incomplete(agg.count_by(rows, "diagnosa_primer"))
    return rank.ranked(counted, "count", ["diagnosa_primer"])


def diagnosis_count(v: DataFrame, reg_type: str, diagnosis: str, **filters) -> DataFrame:
    rows, _ = scoped(v, reg_type=reg_type, **filters)
    return agg.row_count(equals(rows, diagnosa_primer=diagnosis))


def _with_dominant_age(rows: DataFrame, freq: str, dense: bool, label: str) -> DataFrame:
    """Visits and modal age band per bucket, and the mode of those modes.

    Both levels read one shuffle of (bucket, age band) counts.
    """
    out = agg.mode_by(rows, [period(freq)], "kategori_usia", "dominant_age", count_out="count")
    overall = agg.mode_of(out, "dominant_age", "m").scalar()
    if dense:
        counts = series(out.select(PERIOD, "count"), freq, dense=True, label=label)
        ages = series(out.select(PERIOD, "dominant_age"), freq, label=label)
        filled = counts.join(ages, PERIOD, "left").orderBy(PERIOD)
        return filled.withColumn("dominant_age_summary", overall)
    return series(out.withColumn("dominant_age_summary", overall), freq, label=label)


def diagnosis_over_time(
    v: DataFrame, reg_type: str, diagnosis: str, *, dense=False, label="start", **filters
) -> DataFrame:
    rows, freq = scoped(v, reg_type=reg_type, **filters)
    return _with_dominant_age(equals(rows, diagnosa_primer=diagnosis), freq, dense, label)


def departments(v: DataFrame, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return rank.ranked(agg.count_by(rows, "nama_departemen"), "count", ["nama_departemen"])


def department_detail(v: DataFrame, department: str, **filters) -> DataFrame:
    """Visits of one department and its diagnoses as JSON, from one pass."""
    rows, _ = scoped(v, **filters)
    counted = agg.count_by(equals(rows, nama_departemen=department), "diagnosa_primer", out="cnt")
    cells = agg.ordered_cells("cnt", {"diagnosa": "diagnosa_primer", "count": "cnt"})
    total = F.coalesce(F.sum("cnt"), F.lit(0)).cast("long")
    return counted.agg(
        F.lit(department).alias("nama_departemen"),
        total.alias("count"),
        F.when(F.count(F.lit(1)) > 0, F.to_json(cells, {"ignoreNullFields": "false"})).alias(
            "diagnosa_counts"
        ),
    )


def department_over_time(
    v: DataFrame, department: str, *, dense=False, label="start", **filters
) -> DataFrame:
    rows, freq = scoped(v, **filters)
    return _with_dominant_age(equals(rows, nama_departemen=department), freq, dense, label)
