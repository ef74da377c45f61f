"""Unique, new and returning patients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitgrain.operators import aggregate as agg, rank, reshape
from visitgrain.operators.resample import PERIOD
from visitgrain.plans.common import period, scoped, series, year_or_latest_month
from visitgrain.schema import EVENT_TIME, NEW_PATIENT_LABELS, PATIENT


def by_gender(v: DataFrame, **filters) -> DataFrame:
    """Unique patients per gender in a year, or in the latest month."""
    pairs = rank.distinct_on(year_or_latest_month(v, **filters), [PATIENT, "jenis_kelamin"])
    return agg.count_by(pairs, "jenis_kelamin").orderBy("jenis_kelamin")


def by_gender_over_time(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    rows, freq = scoped(v, **filters)
    unique = rank.distinct_on(rows, [PATIENT, "jenis_kelamin", period(freq)])
    values = reshape.categories(rows, "jenis_kelamin") if values is None else values
    return series(reshape.pivot_count(unique, [PERIOD], "jenis_kelamin", values), freq, dense=dense, label=label)


def top_occupations(v: DataFrame, *, k: int = 10, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return rank.top_k(agg.count_by(rows, "pekerjaan"), "count", ["pekerjaan"], k)


def rarest_occupations(v: DataFrame, *, k: int = 10, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    known = rows.filter(F.col("pekerjaan").isNotNull())
    return rank.bottom_k(agg.count_by(known, "pekerjaan"), "count", ["pekerjaan"], k)


def unique_patients(v: DataFrame, *, rsd: float | None = None, **filters) -> DataFrame:
    return agg.distinct_count(year_or_latest_month(v, **filters), PATIENT, rsd=rsd)


def new_per_year(v: DataFrame, **filters) -> DataFrame:
    """Patients by the year of their first visit. Unfiltered unless filters are given."""
    rows, _ = scoped(v, **filters)
    firsts = rank.first_event(rows, PATIENT, EVENT_TIME)
    return agg.count_by(firsts, F.year("first_time").cast("long").alias("tahun")).orderBy("tahun")


def new_and_returning(v: DataFrame, *, count: str = "patients", **filters) -> DataFrame:
    """Two rows, new and returning: distinct patients, or visits with ``count="rows"``."""
    rows = year_or_latest_month(v, **filters)
    if count == "patients":
        # Distinct (flag, patient) pairs first: two plain counts then need no row expansion.
        rows = rank.distinct_on(rows, ["fix_pasien_baru", PATIENT])
    elif count != "rows":
        raise ValueError(f"count must be 'patients' or 'rows', not {count!r}")
    flags = list(NEW_PATIENT_LABELS)
    totals = rows.agg(
        *[F.count(F.when(F.col("fix_pasien_baru") == f, F.col(PATIENT))).alias(f) for f in flags]
    )
    cells = [F.struct(F.lit(NEW_PATIENT_LABELS[f]).alias("kategori"), F.col(f).alias("count")) for f in flags]
    return totals.select(F.inline(F.array(*cells)))


def by_age(v: DataFrame, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    pairs = rank.distinct_on(rows, [PATIENT, "kategori_usia"])
    return agg.count_by(pairs, "kategori_usia").orderBy("kategori_usia")
