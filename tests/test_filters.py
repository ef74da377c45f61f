import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from visitgrain.functions import dates
from visitgrain.functions.predicates import column_predicates, year_bounds
from visitgrain.operators import filters as flt
from visitgrain.sources.tables import read_stored_visits, write_visits

TS = "ts"


@pytest.fixture
def month_end(frame):
    rows = [("2024-08-31 10:30:00",), ("2024-02-29 00:00:00",), ("2024-02-29 10:30:00",),
            ("2024-02-28 23:59:59",), ("2024-03-04 10:30:00",), ("2024-08-01 00:00:00",)]
    return frame(rows, "ts string")


def kept(df):
    return sorted(r[0].strftime("%m-%d %H:%M") for r in df.select("ts").collect())


def test_month_subtraction_clamps_to_month_end(month_end):
    assert kept(flt.last(month_end, TS, "6 MONTHS")) == [
        "02-29 10:30", "03-04 10:30", "08-01 00:00", "08-31 10:30"]
    assert "02-29 00:00" in kept(flt.last_from_day(month_end, TS, "6 MONTHS"))


def test_anchors_differ(month_end):
    # 180 days before 2024-08-31 is 2024-03-04; the bound is the start of that day.
    assert kept(flt.last_days_whole(month_end, TS, 180)) == ["03-04 10:30", "08-01 00:00", "08-31 10:30"]
    assert kept(flt.latest_month(month_end, TS)) == ["08-01 00:00", "08-31 10:30"]
    assert kept(flt.last(month_end, TS, "1 DAY")) == ["08-31 10:30"]


def test_anchor_comes_from_the_whole_table(month_end):
    early = month_end.filter(F.col("ts") < "2024-08-31")
    assert kept(flt.latest_month(early, TS)) == ["08-01 00:00"]
    assert kept(flt.last(early, TS, "1 DAY", anchor=month_end)) == []


def test_empty_and_single_row(frame):
    empty = frame([], "ts string")
    assert flt.last(empty, TS, "6 MONTHS").count() == 0
    assert flt.latest_month(empty, TS).count() == 0
    assert flt.last(frame([("2024-01-01",)], "ts string"), TS, "1 DAY").count() == 1


def test_relative_to_now(frame):
    today = dt.date.today()
    df = frame([(str(today),), (str(today - dt.timedelta(days=40)),)], "ts string")
    assert flt.last_before(df, TS, "1 MONTH").count() == 1
    assert flt.last_before(df, TS, "1 MONTH", as_of=today - dt.timedelta(days=20)).count() == 2


def test_year_bounds():
    assert year_bounds(2024) == (dt.date(2024, 1, 1), dt.date(2025, 1, 1))
    assert year_bounds(2024, 12) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))


def test_time_filter_precedence(month_end):
    assert flt.time_filter(month_end, TS, year=2024, month=8, relative="day").count() == 2
    with pytest.raises(ValueError, match="relative must be"):
        flt.time_filter(month_end, TS, relative="3months")
    assert flt.time_filter(month_end, TS, start="2024-08-01").count() == month_end.count()
    assert flt.time_filter(month_end, TS, start="2024-08-01", end="2024-08-31 10:30:00").count() == 2


def test_predicates(frame):
    df = frame([(1, "a"), (2, "b"), (3, "c")], "n int, s string")
    count = lambda rules: df.filter(column_predicates(rules)).count()
    assert count({}) == 3 and count(None) == 3
    assert count({"s": "a"}) == 1
    assert count({"s": ["a", "c"]}) == 2
    assert count({"n": {"moreEqual": 2, "less": 3}}) == 1
    assert count({"n": {"equal": 2}}) == count({"n": {"equals": 2}}) == 1
    assert count({"n": {"isin": []}}) == 0
    assert count({"n": {"more": 1}, "s": "c"}) == 1
    with pytest.raises(ValueError):
        column_predicates({"n": {"above": 1}})


def test_frequencies():
    assert dates.parse_frequency("2D") == (2, "day")
    assert dates.parse_frequency("ME") == (1, "month")
    for bad in ("0D", "3X", ""):
        with pytest.raises(ValueError):
            dates.parse_frequency(bad)
    assert [dates.grain_for(*a) for a in ((None, None), (None, 5), (2000, None), (2000, 5))] == [
        "year", "year", "month", "day"]


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_year_filter_reaches_the_scan(spark, visits):
    text = plan_of(flt.in_year(visits, "waktu_registrasi", 2000, 5).select("total_tagihan"))
    line = lambda start: next(x for x in text.splitlines() if x.startswith(start))
    assert "visit_year" in line("PartitionFilters") and "visit_month" in line("PartitionFilters")
    assert "GreaterThanOrEqual(waktu_registrasi" in line("PushedFilters")
    assert "LessThan(waktu_registrasi" in line("PushedFilters")
    assert line("ReadSchema") == "ReadSchema: struct<waktu_registrasi:timestamp_ntz,total_tagihan:double>"


def test_latest_filter_prunes_partitions(spark, visits):
    df = flt.latest_month(visits, "waktu_registrasi").select("total_tagihan")
    text = plan_of(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "make_date(visit_year" in text.split("PartitionFilters", 1)[1]


def test_partition_filters_change_nothing(spark, visits):
    """The stored table and the lazy view agree for every kind of time filter."""
    plain = visits.drop("visit_year", "visit_month")
    for keep in (
        lambda d: flt.in_year(d, "waktu_registrasi", 1999, 12),
        lambda d: flt.in_month(d, "waktu_registrasi", 2),
        lambda d: flt.between(d, "waktu_registrasi", "1998-12-15", "1999-01-15"),
        lambda d: flt.last(d, "waktu_registrasi", "6 MONTHS"),
        lambda d: flt.last_days_whole(d, "waktu_registrasi", 180),
        lambda d: flt.last_before(d, "waktu_registrasi", "1 YEAR", as_of="2001-03-31"),
    ):
        assert keep(visits).count() == keep(plain).count() > 0


def test_null_event_time_is_kept_but_never_latest(spark, visits, folder):
    some = visits.drop("visit_year", "visit_month").filter("waktu_registrasi >= '2001-07-01'")
    holed = some.withColumn("waktu_registrasi", F.when(F.col("id_pasien") % 5 > 0, F.col("waktu_registrasi")))
    write_visits(holed, folder("holed"))
    stored = read_stored_visits(spark, folder("holed"))
    assert stored.count() == some.count()
    assert flt.latest_frame(stored).first() == holed.agg(F.max("waktu_registrasi").alias("latest")).first()
