import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitgrain.functions.measures import aggregate_named, bankers_round
from visitgrain.operators import aggregate as agg, rank, reshape, resample
from visitgrain.plans import patients, revenue, visits as vis


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_groups(frame):
    df = frame([("a",), (None,), (None,)], "k string")
    assert rows(agg.count_by(df, "k")) == [("a", 1), (None, 2)]
    assert rows(agg.count_non_null_by(df, "k")) == [("a", 1), (None, 0)]


def test_mode_ties_nulls_and_counts(frame):
    df = frame(
        [("x", "b"), ("x", "a"), ("x", None), ("x", None), ("x", None), ("y", None), ("z", "q"), ("z", "q"), ("z", "p")],
        "k string, v string")
    assert rows(agg.mode_by(df, ["k"], "v", "m", count_out="n")) == [("x", 5, "a"), ("y", 1, None), ("z", 3, "q")]
    assert agg.mode_of(df, "v").first()[0] == "q"
    assert agg.mode_of(df.limit(0), "v").first()[0] is None


def test_mode_agrees_with_the_built_in(visits):
    ours = rows(agg.mode_by(visits, ["nama_departemen"], "diagnosa_primer", "m"))
    theirs = rows(visits.groupBy("nama_departemen").agg(F.mode("diagnosa_primer", True).alias("m")))
    assert ours == theirs


def test_profit_with_a_missing_side(frame):
    df = frame([(10.0, None), (5.0, 2.0)], "a double, b double")
    assert agg.profit(df, "a", "b").first()[0] == 13.0
    assert frame([], "a double, b double").transform(lambda d: agg.profit(d, "a", "b")).first()[0] is None


def test_rounding_half_to_even(frame):
    df = frame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(bankers_round("x")).collect()] == [0.0, 2.0, 2.0, -2.0]


def test_unknown_choices_are_refused(frame):
    with pytest.raises(ValueError):
        aggregate_named("median")
    with pytest.raises(ValueError):
        rank.sort_measure("profit", ["pendapatan", "pengeluaran"])


def test_ranking_ties_and_nulls(frame):
    df = frame([("b", 2), ("a", 2), ("c", 2), ("d", None), (None, 1)], "k string, n int")
    assert [r[0] for r in rank.top_k(df, "n", ["k"], 3).collect()] == ["d", "a", "b"]
    assert [r[0] for r in rank.bottom_k(df, "n", ["k"], 2).collect()] == ["c", None]
    assert [r[0] for r in rank.ranked(df, "n", ["k"]).collect()] == ["d", "a", "b", "c", None]


def test_first_per_key(frame):
    df = frame([("p", "2020-02-01", 2), ("p", "2020-01-01", 9), ("p", "2020-01-01", 3), ("q", None, 1), ("q", "2021-01-01", 5), ("r", None, 7)],
               "k string, ts string, n int")
    assert rows(rank.first_per_key(df, ["k"], "ts").select("k", "n")) == [("p", 3), ("q", 5), ("r", 7)]


def test_distinct_counts(frame):
    df = frame([("t", 1), ("t", 1), ("f", 1), ("f", 2), (None, None)], "flag string, id int")
    assert rows(agg.distinct_count(df, "id", "flag")) == [("f", 2), ("t", 1), (None, 0)]
    assert agg.distinct_count(df, "id").first()[0] == 2
    assert agg.distinct_count(df, "id", rsd=0.05).first()[0] == 2
    assert rows(agg.count_by(rank.distinct_on(df, ["id", "flag"]), "flag")) == [("f", 2), ("t", 1), (None, 1)]


def test_nested_results_keep_null_labels(frame):
    df = frame([("x", None), ("x", "b"), ("x", "b")], "k string, v string")
    assert agg.breakdown_json(df, "v", "d", "j").first()[0] == '[{"d":"b","count":2},{"d":null,"count":1}]'
    assert agg.breakdown_json(df.limit(0), "v", "d", "j").first()[0] is None
    nested = agg.nested_records(df, "k", "v").first()["records"]
    assert [tuple(r) for r in nested] == [(None, 1), ("b", 2)]


@pytest.mark.parametrize("freq,label,expected", [
    ("D", "start", ["2024-01-30", "2024-01-31", "2024-02-01"]),
    ("M", "end", ["2024-01-31", "2024-02-29"]),
    ("Y", "end", ["2024-12-31"]),
    ("W", "end", ["2024-02-04"]),
    ("Q", "end", ["2024-03-31"]),
])
def test_dense_labels(frame, freq, label, expected):
    df = frame([("2024-01-30 05:00:00",), ("2024-02-01 23:00:00",), ("2024-02-01 00:00:00",)], "ts string")
    counted = agg.count_by(resample.with_bucket(df, "ts", freq), "time_period", out="n")
    out = resample.labelled(resample.densify(counted, freq, ["n"]), freq, label).collect()
    assert [r[0] for r in out] == expected
    assert sum(r[1] for r in out) == 3


def test_dense_matches_pandas(frame):
    stamps = ["2023-11-05 10:00:00", "2023-11-20 11:00:00", "2024-03-01 00:00:00", "2024-06-30 23:59:59"]
    df = frame([(s,) for s in stamps], "ts string")
    series = pd.Series(1, index=pd.to_datetime(stamps))
    for freq, alias in (("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("h", "h"), ("Y", "YE")):
        want = series.resample(alias).sum()
        counted = agg.count_by(resample.with_bucket(df, "ts", freq), "time_period", out="n")
        label = "start" if freq in "Dh" else "end"
        got = resample.labelled(resample.densify(counted, freq, ["n"]), freq, label, "yyyy-MM-dd HH").collect()
        assert [tuple(r) for r in got] == [(t.strftime("%Y-%m-%d %H"), n) for t, n in want.items()], freq


def test_dense_per_key_and_empty(frame):
    df = frame([("a", "2024-01-01", 5), ("a", "2024-01-04", 7), ("b", "2024-01-02", 1), ("b", None, 9)],
               "k string, time_period string, n int")
    out = rows(resample.densify(df, "D", ["n"], keys=["k"]).groupBy("k").agg(F.count("*"), F.sum("n")))
    assert out == [("a", 4, 12), ("b", 1, 1)]
    assert resample.densify(df.limit(0), "D", ["n"]).count() == 0


def test_pivot_null_category_and_fill(frame):
    df = frame([("p", "x"), ("p", None), ("q", "y")], "g string, c string")
    assert reshape.categories(df, "c") == ["x", "y"]
    assert rows(reshape.pivot_count(df, ["g"], "c")) == [("p", 1, None), ("q", None, 1)]
    assert rows(reshape.pivot_count(df, ["g"], "c", ["x", "y"], fill=True)) == [("p", 1, 0), ("q", 0, 1)]


def test_sum_of_means_is_not_a_sum(frame):
    df = frame([("2024-01-01", "x", 2.0), ("2024-01-01", "x", 4.0), ("2024-01-02", "x", 10.0)], "ts string, c string, m double")
    out = reshape.pivot_mean_then(df, "ts", F.date_trunc("month", "ts"), "c", ["m"], ["x"]).first()
    assert out["x"] == 13.0


def test_unstack_and_payload(frame):
    df = frame([("p", "x", "1"), ("p", "x", "2"), ("p", None, "2"), ("q", "y", "1")], "g string, a string, b string")
    wide = reshape.unstack_count(df, ["g"], ["a", "b"])
    assert wide.columns == ["g", "x|1", "x|2", "y|1"]
    payload = reshape.columnar_payload(wide, index="g").first()
    assert payload["index"] == ["p", "q"] and payload["values"] == [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]


def test_union_fills_missing_columns(frame):
    out = reshape.union_rows(frame([(1, "a")], "n int, s string"), frame([(2,)], "n int"))
    assert rows(out) == [(1, "a"), (2, None)]


def test_align_keeps_the_index(frame):
    left = frame([("2024-01-01",), ("2024-01-02",)], "time_period string")
    right = frame([("2024-01-02", "x"), ("2024-01-03", "y")], "time_period string, v string")
    assert [r[1] for r in resample.align(left, right).orderBy("time_period").collect()] == [None, "x"]


def test_calendar(frame, visits):
    df = frame([("2019-05-01",), ("2021-02-01",)], "waktu_registrasi string")
    assert [r[0] for r in agg.year_range(df).orderBy("tahun").collect()] == [2019, 2020, 2021]
    assert rows(agg.observed_calendar(df)) == [(2019, 5), (2021, 2)]
    plain = visits.drop("visit_year", "visit_month")
    assert rows(agg.observed_calendar(visits)) == rows(agg.observed_calendar(plain))


def test_room_classes_of_an_unknown_diagnosis(visits):
    assert revenue.diagnosis_room_classes(visits, "none such").collect() == []


def test_detail_of_an_unknown_department(visits):
    assert tuple(vis.department_detail(visits, "none such").first()) == ("none such", 0, None)
    assert vis.department_over_time(visits, "none such").collect() == []


def test_new_and_returning_fills_missing_flags(visits):
    only_new = visits.filter("fix_pasien_baru = 't'")
    out = {r["kategori"]: r["count"] for r in patients.new_and_returning(only_new, year=2000).collect()}
    assert out["Pasien Lama"] == 0 and out["Pasien Baru"] > 0
    with pytest.raises(ValueError):
        patients.new_and_returning(visits, count="visits")


def test_dense_dominant_age_leaves_gaps_null(frame, visits):
    rows_ = visits.filter("nama_departemen = 'Brand#13'")
    out = vis.department_over_time(rows_, "Brand#13", dense=True, year=2000, month=5).collect()
    days = [dt.date.fromisoformat(r["time_period"]) for r in out]
    assert days == [days[0] + dt.timedelta(n) for n in range(len(days))]
    assert all((r["dominant_age"] is None) == (r["count"] == 0) for r in out)


def test_hot_key(spark, visits):
    """A third of all rows on one patient: the same answers as from a plain recount."""
    hot = visits.withColumn("id_pasien", F.when(F.rand(1) < 0.34, F.lit(1)).otherwise(F.col("id_pasien"))).cache()
    pdf = hot.select("id_pasien", "kategori_usia", "waktu_registrasi").toPandas()
    first = pdf.groupby("id_pasien").waktu_registrasi.min().dt.year.value_counts().to_dict()
    assert {r["tahun"]: r["count"] for r in patients.new_per_year(hot).collect()} == first
    pairs = pdf.drop_duplicates(["id_pasien", "kategori_usia"]).kategori_usia.value_counts().to_dict()
    assert {r[0]: r[1] for r in patients.by_age(hot).collect()} == pairs


def test_lazy_view_answers_alike(spark, sf_dir, visits):
    """Without a shared folder queries run over the joins themselves."""
    from visitgrain.plans import utility
    from visitgrain.sources.visits import visits_view

    lazy = visits_view(spark, sf_dir)
    assert lazy.count() == visits.count()
    types = ["IGD", "Rawat Inap", "Rawat Jalan"]
    for plan in (
        vis.growth, utility.last_update, utility.filter_options, patients.new_per_year,
        lambda v: vis.by_registration_type(v, values=types),
        lambda v: patients.by_gender(v, year=2000, district="NATION_3"),
    ):
        assert rows(plan(lazy)) == rows(plan(visits))


def test_combined_labels_never_collide(frame):
    from visitgrain.operators import reshape

    df = frame([("k", "a|b", "c"), ("k", "a", "b|c"), ("k", "a\\", "b"), ("k", "a", "b")], "k string, x string, y string")
    wide = reshape.unstack_count(df, ["k"], ["x", "y"])
    assert set(wide.columns) == {"k", "a\\|b|c", "a|b\\|c", "a\\\\|b", "a|b"}
    assert all(wide.first()[c] == 1 for c in wide.columns[1:])
    assert {(r.x, r.n) for r in reshape.long_count(df, ["k"], "x").collect()} == {("a|b", 1), ("a", 2), ("a\\", 1)}
