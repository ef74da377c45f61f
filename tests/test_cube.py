"""The cube against plain sums over the rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitgrain.operators.cube import cube, default_label, preset

CATS, M1, M2 = ["c"], "m", "k"


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 400
    hours = rng.integers(0, 24 * 20, n)
    # A third of the rows share one timestamp.
    hours[: n // 3] = 100
    out = pd.DataFrame({
        "ts": pd.Timestamp("2024-01-28") + pd.to_timedelta(hours * 3, unit="h"),
        "c": rng.choice(["x", "y", "z", None], n, p=[0.5, 0.2, 0.2, 0.1]),
        "d": rng.choice(["p", "q"], n),
        "m": rng.normal(100, 20, n).round(2),
        "k": rng.integers(0, 50, n).astype(float),
    })
    out.loc[rng.random(n) < 0.1, "m"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, pdf):
    rows = pdf.astype(object).where(pdf.notna(), None)
    made = spark.createDataFrame(
        [(str(r.ts), r.c, r.d, r.m, r.k) for r in rows.itertuples()], "ts string, c string, d string, m double, k double")
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def label(ts, freq):
    """Name of the bucket that holds ``ts``: weeks and months by their last day, the rest by their first."""
    day = ts.date()
    if freq == "W":
        return day + dt.timedelta(days=6 - day.weekday())
    if freq == "M":
        return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    if freq == "2D":
        return day - dt.timedelta(days=(day - dt.date(1970, 1, 1)).days % 2)
    return day


def by_bucket(cells, freq, agg, names):
    """Sum or mean of (timestamp, name, number) cells, zero in buckets between the first and the last."""
    days = sorted(label(t, freq) for t, _, _ in cells)
    spread = {label(dt.datetime.combine(days[0], dt.time()) + dt.timedelta(days=i), freq) for i in range((days[-1] - days[0]).days + 1)}
    out = {d: {n: [] for n in names} for d in sorted(spread)}
    for t, name, number in cells:
        out[label(t, freq)][name].append(number)
    total = lambda v: sum(v) / (len(v) if agg == "mean" and v else 1)
    frame = {d: {n: total(v) for n, v in row.items()} for d, row in out.items()}
    made = pd.DataFrame.from_dict(frame, orient="index", columns=names)
    made.index = pd.to_datetime(made.index)
    return made


def counted(pdf):
    """(timestamp, category, rows) of every timestamp that has a category, zeros included."""
    seen = {}
    for r in pdf.itertuples():
        if r.c is not None:
            seen.setdefault(r.ts, dict.fromkeys("xyz", 0))[r.c] += 1
    return [(t, c, n) for t, row in seen.items() for c, n in row.items()]


def averaged(pdf, measures):
    """(timestamp, name, mean) per category of every timestamp that has a known one, zeros included."""
    seen = {}
    for r in pdf.itertuples():
        values = [(m, getattr(r, m)) for m in measures if not np.isnan(getattr(r, m))]
        if r.c is not None and values:
            row = seen.setdefault(r.ts, {(m, c): [] for m in measures for c in "xyz"})
            for m, v in values:
                row[m, r.c].append(v)
    name = lambda m, c: c if len(measures) == 1 else f"{m}_{c}"
    return [(t, name(*k), sum(v) / len(v) if v else 0.0) for t, row in seen.items() for k, v in row.items()]


def same(got, want: pd.DataFrame):
    got = got.toPandas().set_index("time_period")
    want = want.fillna(0)
    assert list(got.index) == list(want.index.strftime("%Y-%m-%d"))
    assert sorted(got.columns) == sorted(want.columns)
    np.testing.assert_allclose(got[want.columns].to_numpy(float), want.to_numpy(float), rtol=1e-9)


@pytest.mark.parametrize("freq", ["D", "W", "M", "2D"])
@pytest.mark.parametrize("agg", ["sum", "mean"])
def test_series(df, pdf, freq, agg):
    run = lambda cats, measures, **kw: cube(df, "ts", cats, measures, mode="series", freq=freq, agg=agg, **kw)
    same(run(CATS, []), by_bucket(counted(pdf), freq, agg, [*"xyz"]))
    plain = [(r.ts, m, getattr(r, m)) for r in pdf.itertuples() for m in (M1, M2) if not np.isnan(getattr(r, m))]
    same(run([], [M1, M2]), by_bucket(plain, freq, agg, [M1, M2]))
    same(run(CATS, [M1], pivot=True), by_bucket(averaged(pdf, [M1]), freq, agg, [*"xyz"]))
    # Every raw row meets the counts of its own timestamp.
    at = {}
    for t, c, n in counted(pdf):
        at.setdefault(t, []).append((c, n))
    met = [(r.ts, name, x) for r in pdf.itertuples() if r.ts in at
           for name, x in [*at[r.ts], (M1, r.m), (M2, r.k)] if not np.isnan(x)]
    same(run(CATS, [M1, M2], compat=True), by_bucket(met, freq, agg, [*"xyz", M1, M2]))


def test_counts_beside_measures_are_not_multiplied(df, pdf):
    out = cube(df, "ts", CATS, [M2], mode="series").toPandas()
    assert out[["x", "y", "z"]].to_numpy().sum() == pdf.c.notna().sum()
    assert out[M2].sum() == pytest.approx(pdf[M2].sum())


def test_pivot_of_several_measures(df, pdf):
    want = by_bucket(averaged(pdf, [M1, M2]), "D", "sum", [f"{m}_{c}" for m in (M1, M2) for c in "xyz"])
    same(cube(df, "ts", CATS, [M1, M2], mode="series", pivot=True), want)


@pytest.mark.parametrize("agg", ["sum", "mean"])
def test_series_aggregate(df, pdf, agg):
    got = {r["index"]: r["value"] for r in cube(df, "ts", CATS, [], mode="series_aggregate", agg=agg).collect()}
    daily = by_bucket(counted(pdf), "D", agg, [*"xyz"])
    # A day without rows has no mean, so it is left out of the mean of days.
    days = len({t.date() for t, _, _ in counted(pdf)}) if agg == "mean" else 1
    assert got == pytest.approx({c: daily[c].sum() / days for c in "xyz"})


def test_aggregate(df, pdf):
    got = {r["c"]: r["count"] for r in cube(df, "ts", CATS, mode="aggregate").collect()}
    assert got == pdf.c.value_counts().to_dict()
    got = {r["index"]: r["value"] for r in cube(df, "ts", [], [M1, M2], mode="aggregate", agg="mean").collect()}
    assert got == pytest.approx(pdf[[M1, M2]].mean().to_dict())
    for agg in ("sum", "mean"):
        mean = lambda c, m: pdf[pdf.c == c][m].dropna().mean()
        want = {c: (mean(c, M1) + mean(c, M2)) / (2 if agg == "mean" else 1) for c in "xyz"}
        got = {r["c"]: r["value"] for r in cube(df, "ts", CATS, [M1, M2], mode="aggregate", pivot=True, agg=agg).collect()}
        assert got == pytest.approx(want)
    both = {r["c"]: (r["count"], r[M2]) for r in cube(df, "ts", CATS, [M2], mode="aggregate").collect()}
    assert both["x"] == (int((pdf.c == "x").sum()), pdf[pdf.c == "x"][M2].sum())


def test_several_categories(df, pdf):
    wide = cube(df, "ts", ["c", "d"], [], mode="series", freq="M").toPandas()
    assert set(wide.columns) == {"time_period", *[f"{c}|{d}" for c in "xyz" for d in "pq"]}
    assert wide.drop(columns="time_period").to_numpy().sum() == pdf.c.notna().sum()


def test_filters_hooks_and_raw(df, pdf):
    out = cube(df, "ts", ["c"], [M2], filters={"d": "p", M2: {"less": 20}}, start="2024-02-01", end="2024-02-20",
               preprocess=lambda f: f.filter("c = 'x'"), postprocess=lambda f: f.drop("c"))
    want = pdf[(pdf.d == "p") & (pdf.k < 20) & (pdf.c == "x") & pdf.ts.between("2024-02-01", "2024-02-20")]
    assert out.columns == ["ts", M2]
    assert sorted(r[1] for r in out.collect()) == sorted(want.k)
    assert cube(df, "ts", [], [M1]).filter(f"{M1} is null").count() == 0


def test_forecast_mode(df):
    smoothed = cube(df, "ts", CATS, mode="forecast", holdout=5, horizon=7).toPandas()
    assert smoothed.groupby("series_key").size().to_dict() == {"x": 7, "y": 7, "z": 7}


def test_refusals(df):
    with pytest.raises(ValueError):
        cube(df, "ts", mode="series")
    with pytest.raises(ValueError):
        cube(df, "ts", CATS, mode="table")
    with pytest.raises(ValueError):
        cube(df, "ts", CATS, mode="series", agg="median")
    with pytest.raises(KeyError):
        preset(df, "no such preset")


def test_labels_default_to_the_period_end_for_long_buckets():
    assert [default_label(f) for f in ("h", "D", "W", "M", "ME", "MS", "Y", "QS")] == [
        "start", "start", "end", "end", "end", "start", "end", "start"]
