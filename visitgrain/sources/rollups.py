"""Partial results kept beside a stored visits table, one set of rows for each month.

A roll-up is what some months' visits come to before the last step of a query: sums per day, bitmaps
of patients per month, the first visit of each patient in the month. Partial results of months add up to
those of any range, so a query reads them instead of visits; a load changes only the months it touches.

``ensure`` makes the months that are missing and returns the rows for the files of the frame it is
given. Stored rows carry the digest of the month's files (``summary``), so rows of an earlier state of
a month are never read, a month is never counted twice, and what an interrupted write left counts for nothing. Only the
frame that is a whole stored table has roll-ups; for any other frame the answer is None and the caller reads the visits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitgrain.schema import COST, EVENT_TIME, PARTITION_MONTH, PARTITION_YEAR, PARTITIONS, PATIENT, REVENUE
from visitgrain.session import finer_shuffles
from visitgrain.sources import summary
from visitgrain.sources.fs import delete, finished, hadoop_path

FOLDER, REFRESH = "_rollups", "refresh"
N, BUCKET, BITS = "n_visits", "bucket", "patients"


@dataclass(frozen=True)
class Rollup:
    """``make`` turns visits into partial results that have the partition columns."""

    name: str
    make: Callable[[DataFrame], DataFrame]


def _day() -> Column:
    return F.to_date(EVENT_TIME).cast("timestamp_ntz").alias(EVENT_TIME)


def _daily(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy(*PARTITIONS, _day(), "jenis_registrasi", "kabupaten")
    return grouped.agg(F.count(F.lit(1)).alias(N), F.sum(REVENUE).alias(REVENUE), F.sum(COST).alias(COST))


def _patients(rows: DataFrame) -> DataFrame:
    known = rows.filter(F.col(PATIENT).isNotNull())
    month = F.trunc(EVENT_TIME, "MM").cast("timestamp_ntz").alias(EVENT_TIME)
    grouped = known.groupBy(*PARTITIONS, month, "jenis_kelamin", "kategori_usia", F.bitmap_bucket_number(PATIENT).alias(BUCKET))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position(PATIENT)).alias(BITS))


def _firsts(rows: DataFrame) -> DataFrame:
    known = rows.filter(F.col(PATIENT).isNotNull())
    return known.groupBy(*PARTITIONS, PATIENT).agg(F.min(EVENT_TIME).alias(EVENT_TIME))


#: Visits, revenue and cost per day, registration type and district.
DAILY = Rollup("daily", _daily)
#: Which patients came, per month, gender and age band: 4 KB for each 32,768 patients, before compression.
#: By days the bitmaps would be mostly empty.
PATIENTS = Rollup("patients-by-month", _patients)
#: Each patient's first visit in a month; the least over all months is the first of all.
FIRSTS = Rollup("firsts", _firsts)


def _stored(spark: SparkSession, base: str) -> dict[tuple[int, int, str], str]:
    """(year, month, digest) -> folder, the earliest where two refreshes made the same."""
    found: dict[tuple[int, int, str], str] = {}
    for refresh in finished(spark, f"{base}/{REFRESH}=*"):
        jpath, fs = hadoop_path(spark, f"{refresh}/{summary.DIGEST}=*/{PARTITION_YEAR}=*/{PARTITION_MONTH}=*")
        for status in fs.globStatus(jpath) or []:
            leaf = status.getPath().toString()
            digest, year, month = (part.split("=", 1)[1] for part in leaf.rsplit("/", 3)[1:])
            found.setdefault((int(year), int(month), digest), leaf)
    return found


def ensure(v: DataFrame, rollup: Rollup) -> DataFrame | None:
    """The roll-up's rows for a frame that is a whole stored table; missing months are made first."""
    path, months = summary.stored_path(v), summary.months_of(v)
    if path is None or not months:
        return None
    spark, base = v.sparkSession, f"{path}/{FOLDER}/{rollup.name}"
    wanted = [(*k, digest) for k, (_, digest) in months.items()]
    have = _stored(spark, base)
    lacking = [w for w in wanted if w not in have]
    made = rollup.make(v)
    if lacking:
        number = F.col(PARTITION_YEAR) * 12 + F.col(PARTITION_MONTH)
        of_months = v.where(F.col(PARTITION_YEAR).isin(sorted({y for y, _, _ in lacking})) & number.isin([y * 12 + m for y, m, _ in lacking]))
        digests = spark.createDataFrame(lacking, f"{PARTITION_YEAR} int, {PARTITION_MONTH} int, {summary.DIGEST} string")
        fresh = rollup.make(of_months).join(digests, list(PARTITIONS)).hint("rebalance", *PARTITIONS)
        with finer_shuffles(spark, 0):  # what is read is large, what is shuffled is not
            fresh.write.partitionBy(summary.DIGEST, *PARTITIONS).parquet(f"{base}/{REFRESH}={uuid.uuid4().hex[:12]}")
        have = _stored(spark, base)
    leaves = [have[w] for w in wanted if w in have]
    if not leaves:
        return spark.createDataFrame([], made.schema)
    return spark.read.schema(made.schema).option("basePath", base).parquet(*leaves).select(*made.columns)


def clear_old(v: DataFrame, rollup: Rollup) -> None:
    """Remove the roll-up's refreshes that hold no month of the table as it is now. Readers of an
    earlier state of the table must be done."""
    path, months = summary.stored_path(v), summary.months_of(v)
    if path is None or months is None:
        return
    spark, base = v.sparkSession, f"{path}/{FOLDER}/{rollup.name}"
    wanted = {(*k, digest) for k, (_, digest) in months.items()}
    used = {leaf.split(f"/{REFRESH}=", 1)[1].split("/", 1)[0] for w, leaf in _stored(spark, base).items() if w in wanted}
    for refresh in finished(spark, f"{base}/{REFRESH}=*"):
        if refresh.rsplit("=", 1)[1] not in used:
            delete(spark, refresh)
