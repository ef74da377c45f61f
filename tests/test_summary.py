"""The summary beside a stored visits table: same answers as the table, no scan of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitgrain.operators import aggregate as agg, filters as flt
from visitgrain.operators.reshape import categories
from visitgrain.plans import utility
from visitgrain.schema import EVENT_TIME, VISIT_SCHEMA
from visitgrain.sources import summary
from visitgrain.sources.tables import read_stored_visits, write_visits

TS = EVENT_TIME


@pytest.fixture
def stored(spark, visits, folder):
    path = folder("visits")
    write_visits(visits, path, mode="error")
    return path


def plan(df):
    return df._jdf.queryExecution().toString()


def empty_month(spark, visits, path, year=2030, month=1):
    rows = spark.createDataFrame([], VISIT_SCHEMA).coalesce(1)
    rows.write.parquet(f"{path}/visit_year={year}/visit_month={month}")


def plain(spark, path):
    """The same rows as a frame that no summary describes."""
    return read_stored_visits(spark, path).where(F.lit(True))


def test_session_keeps_the_switch_of_spark(spark):
    assert spark.conf.get("spark.sql.optimizer.metadataOnly", "false") == "false"


def test_rows_of_the_summary(spark, stored):
    v = read_stored_visits(spark, stored)
    got = {(r.visit_year, r.visit_month): r for r in summary.summary_of(v).collect()}
    for r in v.groupBy("visit_year", "visit_month").agg(
        F.count("*").alias("n"), F.min(TS).alias("a"), F.max(TS).alias("b"), F.array_sort(F.collect_set("kabupaten")).alias("k")
    ).collect():
        s = got.pop((r.visit_year, r.visit_month))
        assert (s["rows"], s.first_time, s.last_time, s.kabupaten) == (r.n, r.a, r.b, r.k) and s.files > 0
    assert not got


@pytest.mark.parametrize("refreshed", [False, True])
def test_month_without_rows(spark, visits, stored, refreshed):
    want = plain(spark, stored)
    latest, rows = want.agg(F.max(TS)).first()[0], flt.last(want, TS, "6 MONTHS").count()
    calendar, years = sorted(agg.observed_calendar(want).collect()), agg.year_range(want).collect()
    empty_month(spark, visits, stored)
    if refreshed:
        summary.refresh(spark, stored)
    v = read_stored_visits(spark, stored)
    assert (summary.summary_of(v) is not None) == refreshed
    assert flt.latest_frame(v).first().latest == latest and flt.last(v, TS, "6 MONTHS").count() == rows > 0
    assert sorted(agg.observed_calendar(v).collect()) == calendar and agg.year_range(v).collect() == years
    assert utility.last_update(v).first()[0] == f"{latest:%Y-%m-%d %H:%M:%S}"


def test_plans_read_the_summary_alone(spark, stored):
    v = read_stored_visits(spark, stored)
    for df in (flt.latest_frame(v), agg.observed_calendar(v), agg.year_span(v), agg.distinct_values(v, "kabupaten"),
               utility.last_update(v), utility.filter_options(v), utility.filter_options(v, observed=True)):
        text = plan(df)
        assert "_summary" in text and "id_registrasi" not in text and "total_tagihan" not in text
    assert sorted(map(tuple, utility.filter_options(v).collect())) == sorted(map(tuple, utility.filter_options(plain(spark, stored)).collect()))


def test_filtered_frames_are_answered_from_their_rows(spark, stored):
    v = read_stored_visits(spark, stored)
    one = flt.in_year(v, TS, 1995)
    assert summary.summary_of(one) is None and flt.latest_frame(one).first().latest.year == 1995
    assert {r.tahun for r in agg.observed_calendar(one).collect()} == {1995}
    assert categories(one, "kabupaten") == sorted(r[0] for r in one.select("kabupaten").distinct().collect())
    assert categories(v, "kabupaten") == categories(plain(spark, stored), "kabupaten")


def test_only_changed_months_are_read_again(spark, visits, stored, monkeypatch):
    more = visits.limit(3).withColumn(TS, F.lit("2031-05-06 07:00:00").cast("timestamp_ntz")).withColumn("kabupaten", F.lit(None).cast("string"))
    before = {(r.visit_year, r.visit_month): r.digest for r in summary.summary_of(read_stored_visits(spark, stored)).collect()}
    write_visits(more, stored)
    v = read_stored_visits(spark, stored)
    after = {(r.visit_year, r.visit_month): r.digest for r in summary.summary_of(v).collect()}
    assert {k for k in after if before.get(k) != after[k]} == {(2031, 5)}
    assert flt.latest_frame(v).first().latest == dt.datetime(2031, 5, 6, 7)
    assert None in {r[0] for r in agg.distinct_values(v, "kabupaten").collect()} and None not in categories(v, "kabupaten")
    assert len(summary._versions(spark, stored)) == 2
    write_visits(more.withColumn(TS, F.lit("2031-06-06").cast("timestamp_ntz")), stored)
    assert len(summary._versions(spark, stored)) == 2


def test_another_writer_is_seen(spark, visits, stored):
    row = visits.limit(1).select(*[F.lit("2040-01-02").cast("timestamp_ntz").alias(c) if c == TS else F.col(c) for c in VISIT_SCHEMA.names])
    row.write.parquet(f"{stored}/visit_year=2040/visit_month=1")
    assert flt.latest_frame(read_stored_visits(spark, stored)).first().latest == dt.datetime(2040, 1, 2)


def test_empty_table_and_rows_without_time(spark, visits, folder):
    write_visits(visits.limit(0), folder("none"), mode="error")
    v = read_stored_visits(spark, folder("none"))
    assert flt.latest_frame(v).first().latest is None and agg.year_range(v).collect() == []
    write_visits(visits.limit(5).withColumn(TS, F.when(F.rand(1) < 0, F.col(TS))), folder("null"), mode="error")
    v = read_stored_visits(spark, folder("null"))
    assert flt.latest_frame(v).first().latest is None and agg.distinct_values(v, "kabupaten").count() >= 1
