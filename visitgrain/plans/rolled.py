"""Dashboard queries answered from roll-ups, with the arguments and results of the plain ones.

A roll-up answers where it has the columns that a query filters and groups by and where its grain
suffices: days for sums, months for patients. A range that begins inside a day takes that one day from the visits. A frame without
roll-ups, or a filter they lack, is answered by the plain query.

Patients are counted as bits, so rows without a patient's id don't count as a patient.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.operators import aggregate as agg, reshape
from visitgrain.operators.filters import from_time, last_from_day, latest_frame
from visitgrain.operators.resample import PERIOD
from visitgrain.plans import patients, revenue, visits
from visitgrain.plans.common import period, scoped, series, year_or_latest_month
from visitgrain.schema import COST, EVENT_TIME, PATIENT, REVENUE
from visitgrain.sources.rollups import BITS, BUCKET, DAILY, FIRSTS, N, PATIENTS, ensure


def _last_six_months(rolled: DataFrame, v: DataFrame) -> DataFrame:
    """Days since six months before the latest time; the first of them, if not whole, from the visits."""

    def bound(f: Callable[[Column], Column]) -> Column:
        low = F.col("latest") - F.expr("INTERVAL 6 MONTHS")
        return latest_frame(v).select(f(low).cast("timestamp_ntz")).scalar()

    whole = from_time(rolled, EVENT_TIME, bound(lambda t: F.date_add(F.to_date(t), 1)))
    day = from_time(v, EVENT_TIME, bound(lambda t: t))
    part = day.filter(F.col(EVENT_TIME) < bound(lambda t: F.date_add(F.to_date(t), 1)))
    return whole.unionByName(DAILY.make(part))


def growth(v: DataFrame, *, dense: bool = False, label: str = "start", **filters) -> DataFrame:
    rolled = ensure(v, DAILY)
    if rolled is None:
        return visits.growth(v, dense=dense, label=label, **filters)
    rows, freq = scoped(rolled, recent=lambda d, _: last_from_day(d, EVENT_TIME, "6 MONTHS", v), **filters)
    return series(agg.sum_by(rows, [period(freq)], jumlah_kunjungan=N), freq, dense=dense, label=label)


def _recent(rolled: DataFrame, v: DataFrame, filters: dict) -> tuple[DataFrame, str]:
    if filters.get("year") is None:
        rows, _ = scoped(_last_six_months(rolled, v), **filters)
        return rows, "day"
    return scoped(rolled, **filters)


def revenue_by_registration_type(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    rolled = ensure(v, DAILY)
    if rolled is None:
        return revenue.by_registration_type(v, values=values, dense=dense, label=label, **filters)
    rows, freq = _recent(rolled, v, filters)
    wide = reshape.pivot_measure(rows, [period(freq)], "jenis_registrasi", F.sum(REVENUE), values, fill=True)
    return series(wide, freq, dense=dense, label=label)


def revenue_over_time(v: DataFrame, *, dense=False, label="start", **filters) -> DataFrame:
    rolled = ensure(v, DAILY)
    if rolled is None:
        return revenue.over_time(v, dense=dense, label=label, **filters)
    rows, freq = _recent(rolled, v, filters)
    sums = agg.sum_by(rows, [period(freq)], **{REVENUE: REVENUE, COST: COST})
    return series(sums, freq, dense=dense, label=label)


def _bits(v: DataFrame, filters: dict) -> DataFrame | None:
    """The patients' bitmaps, unless a filter asks for a column that they lack."""
    lacks = any(filters.get(k) is not None for k in ("district", "reg_type"))
    return None if lacks else ensure(v, PATIENTS)


def _patients(rows: DataFrame, *keys: str | Column, out: str = "count") -> DataFrame:
    """Distinct patients per group: bitmaps are united per bucket of ids, then their bits counted."""
    names = [k if isinstance(k, str) else PERIOD for k in keys]
    united = rows.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    return united.groupBy(*names).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(out))


def patients_by_gender(v: DataFrame, **filters) -> DataFrame:
    rolled = _bits(v, filters)
    if rolled is None:
        return patients.by_gender(v, **filters)
    return _patients(_year_or_latest_month(rolled, v, filters), "jenis_kelamin").orderBy("jenis_kelamin")


def _year_or_latest_month(rolled: DataFrame, v: DataFrame, filters: dict) -> DataFrame:
    if filters.get("year") is not None:
        return year_or_latest_month(rolled, **filters)
    low = latest_frame(v).select(F.trunc("latest", "MM").cast("timestamp_ntz")).scalar()
    return from_time(rolled, EVENT_TIME, low)


def patients_by_gender_over_time(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    daily = filters.get("year") is not None and filters.get("month") is not None
    rolled = None if daily else _bits(v, filters)
    if rolled is None:
        return patients.by_gender_over_time(v, values=values, dense=dense, label=label, **filters)
    rows, freq = scoped(rolled, **filters)
    values = reshape.categories(rows, "jenis_kelamin") if values is None else values
    counted = _patients(rows, period(freq), "jenis_kelamin")
    wide = counted.groupBy(PERIOD).pivot("jenis_kelamin", list(values)).agg(F.sum("count"))
    return series(wide, freq, dense=dense, label=label)


def unique_patients(v: DataFrame, **filters) -> DataFrame:
    rolled = _bits(v, filters)
    if rolled is None:
        return patients.unique_patients(v, **filters)
    return _patients(_year_or_latest_month(rolled, v, filters))


def patients_by_age(v: DataFrame, **filters) -> DataFrame:
    rolled = _bits(v, filters)
    if rolled is None:
        return patients.by_age(v, **filters)
    rows, _ = scoped(rolled, **filters)
    return _patients(rows, "kategori_usia").orderBy("kategori_usia")


def new_per_year(v: DataFrame, **filters) -> DataFrame:
    filtered = any(value is not None for value in filters.values())
    rolled = None if filtered else ensure(v, FIRSTS)
    if rolled is None:
        return patients.new_per_year(v, **filters)
    firsts = rolled.groupBy(PATIENT).agg(F.min(EVENT_TIME).alias("first_time"))
    return agg.count_by(firsts, F.year("first_time").cast("long").alias("tahun")).orderBy("tahun")
