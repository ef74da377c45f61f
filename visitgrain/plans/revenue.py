"""Revenue, cost and profit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitgrain.functions.measures import bankers_round
from visitgrain.operators import aggregate as agg, rank, reshape
from visitgrain.operators.filters import drop_incomplete, equals, last
from visitgrain.operators.resample import PERIOD
from visitgrain.plans.common import period, scoped, series, year_or_latest_month
from visitgrain.schema import COST, EVENT_TIME, INPATIENT, PATIENT, REVENUE

BOTH = {"pendapatan": REVENUE, "pengeluaran": COST}


def _last_six_months(d: DataFrame, whole: DataFrame) -> DataFrame:
    return last(d, EVENT_TIME, "6 MONTHS", whole)


def by_registration_type(
    v: DataFrame, *, values: Sequence[str] | None = None, dense=False, label="start", **filters
) -> DataFrame:
    """Zero-filled revenue; without a year, daily over the last six months."""
    rows, freq = scoped(v, recent=_last_six_months, **filters)
    wide = reshape.pivot_measure(
        rows, [period(freq)], "jenis_registrasi", F.sum(REVENUE), values, fill=True
    )
    return series(wide, freq, dense=dense, label=label)


def registration_type_history(v: DataFrame, **filters) -> DataFrame:
    """The same series in long form (series_key, time_period, value), for forecasting."""
    rows, freq = scoped(v, recent=_last_six_months, **filters)
    return agg.sum_by(rows, [F.col("jenis_registrasi").alias("series_key"), period(freq)], value=REVENUE)


def _per(v: DataFrame, key: str, sums: dict[str, str], **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.sum_by(rows, [key], **sums)


def revenue_per_payer(v: DataFrame, **filters) -> DataFrame:
    return _per(v, "jenis_penjamin", {"total": REVENUE}, **filters)


def cost_per_payer(v: DataFrame, **filters) -> DataFrame:
    return _per(v, "jenis_penjamin", {"total": COST}, **filters)


def both_per_payer(v: DataFrame, **filters) -> DataFrame:
    return _per(v, "jenis_penjamin", BOTH, **filters)


def last_day(v: DataFrame, **filters) -> DataFrame:
    """Revenue and cost from one day before the latest event time on."""
    rows, _ = scoped(v, **filters)
    return agg.sum_by(last(rows, EVENT_TIME, "1 DAY", v), [], **BOTH)


def total_revenue(v: DataFrame, **filters) -> DataFrame:
    return agg.sum_by(year_or_latest_month(v, **filters), [], total=REVENUE)


def total_cost(v: DataFrame, **filters) -> DataFrame:
    return agg.sum_by(year_or_latest_month(v, **filters), [], total=COST)


def totals(v: DataFrame, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.sum_by(rows, [], **BOTH)


def profit(v: DataFrame, **filters) -> DataFrame:
    return agg.profit(year_or_latest_month(v, **filters), REVENUE, COST)


def tiles(v: DataFrame, **filters) -> DataFrame:
    """The headline figures of one period from a single scan and a single shuffle: revenue,
    cost, profit and unique patients, new and returning.

    Rows are reduced to one per patient on the map side, so no distinct count expands them.
    """
    rows = year_or_latest_month(v, **filters)
    flag = F.col("fix_pasien_baru")
    per_patient = rows.groupBy(PATIENT).agg(
        F.sum(REVENUE).alias("r"),
        F.sum(COST).alias("c"),
        F.max((flag == "t").cast("int")).alias("new"),
        F.max((flag == "f").cast("int")).alias("old"),
    )
    known = F.col(PATIENT).isNotNull().cast("int")
    return per_patient.agg(
        F.sum("r").alias("pendapatan"),
        F.sum("c").alias("pengeluaran"),
        (F.sum("r") - F.sum("c")).alias("profit"),
        F.count(PATIENT).alias("pasien"),
        F.coalesce(F.sum(F.col("new") * known), F.lit(0)).alias("pasien_baru"),
        F.coalesce(F.sum(F.col("old") * known), F.lit(0)).alias("pasien_lama"),
    )


def revenue_per_diagnosis(v: DataFrame, **filters) -> DataFrame:
    sums = _per(v, "diagnosa_primer", {"pendapatan": REVENUE}, **filters)
    return rank.ranked(sums, "pendapatan", ["diagnosa_primer"])


def cost_per_diagnosis(v: DataFrame, **filters) -> DataFrame:
    sums = _per(v, "diagnosa_primer", {"pengeluaran": COST}, **filters)
    return rank.ranked(sums, "pengeluaran", ["diagnosa_primer"])


def diagnosis_payers(v: DataFrame, diagnosis: str, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.sum_by(equals(rows, diagnosa_primer=diagnosis), ["jenis_penjamin"], **BOTH)


def diagnosis_room_classes(v: DataFrame, diagnosis: str, **filters) -> DataFrame:
    """Inpatient revenue and cost per room class, the class's average stay, and the average stay
    over all classes rounded half to even."""
    rows, _ = scoped(v, reg_type=INPATIENT, **filters)
    per_class = (
        equals(rows, diagnosa_primer=diagnosis)
        .groupBy("kelas_hak")
        .agg(
            F.sum(REVENUE).alias("pendapatan"),
            F.sum(COST).alias("pengeluaran"),
            F.avg("los_rawatan").alias("avg_los"),
            F.sum("los_rawatan").alias("_sum"),
            F.count("los_rawatan").alias("_n"),
        )
    )
    # A mean of nothing is null, and shown as 0.
    overall = F.try_divide(F.sum("_sum"), F.sum("_n"))
    stay = per_class.agg(F.coalesce(bankers_round(overall), F.lit(0.0)).alias("s")).scalar()
    return per_class.drop("_sum", "_n").withColumn("avg_los_rawatan", stay)


def all_diagnoses(v: DataFrame, *, sort: str = "pendapatan", **filters) -> DataFrame:
    sums = drop_incomplete(_per(v, "diagnosa_primer", BOTH, **filters))
    return rank.ranked(sums, rank.sort_measure(sort, list(BOTH)), ["diagnosa_primer"])


def clinic_diagnoses(v: DataFrame, clinic: str, *, sort: str = "pendapatan", **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    sums = agg.sum_by(equals(rows, nama_departemen=clinic), ["diagnosa_primer"], **BOTH)
    return rank.ranked(sums, rank.sort_measure(sort, list(BOTH)), ["diagnosa_primer"])


def clinic_payers(v: DataFrame, clinic: str, **filters) -> DataFrame:
    rows, _ = scoped(v, **filters)
    return agg.sum_by(equals(rows, nama_departemen=clinic), ["jenis_penjamin"], **BOTH)


def all_clinics(v: DataFrame, *, sort: str = "pendapatan", **filters) -> DataFrame:
    sums = drop_incomplete(_per(v, "nama_departemen", BOTH, **filters))
    return rank.ranked(sums, rank.sort_measure(sort, list(BOTH)), ["nama_departemen"])


def top_clinics(v: DataFrame, *, sort: str = "pendapatan", k: int = 10, **filters) -> DataFrame:
    sums = _per(v, "nama_departemen", BOTH, **filters)
    return rank.top_k(sums, rank.sort_measure(sort, list(BOTH)), ["nama_departemen"], k)


def over_time(v: DataFrame, *, dense=False, label="start", **filters) -> DataFrame:
    """Revenue and cost per bucket; without a year, daily over the last six months."""
    rows, freq = scoped(v, recent=_last_six_months, **filters)
    sums = agg.sum_by(rows, [period(freq)], **{REVENUE: REVENUE, COST: COST})
    return series(sums, freq, dense=dense, label=label)


def measure_history(v: DataFrame, **filters) -> DataFrame:
    """Revenue and cost as two long series (series_key, time_period, value)."""
    rows, freq = scoped(v, recent=_last_six_months, **filters)
    sums = agg.sum_by(rows, [period(freq)], **{REVENUE: REVENUE, COST: COST})
    return reshape.melt(sums, [PERIOD], [REVENUE, COST], "series_key", "value")
