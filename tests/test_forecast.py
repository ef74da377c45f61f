import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitgrain.forecast import arima, smoothing, trend


@pytest.fixture
def history(frame):
    def make(**series):
        rows = [
            (key, str(dt.date(2024, 1, 1) + dt.timedelta(days=i)), float(y))
            for key, ys in series.items() for i, y in enumerate(ys)
        ]
        return frame(rows, "series_key string, time_period string, value double")

    return make


def ar(phi, n, seed):
    rng = np.random.default_rng(seed)
    y = [0.0]
    for e in rng.normal(size=n - 1):
        y.append(phi * y[-1] + e)
    return np.asarray(y) + 20


def test_simple_smoothing_matches_the_recursion(history):
    ys = [3.0, 5.0, 4.0, 8.0]
    level = ys[0]
    for y in ys[1:]:
        level = 0.3 * y + 0.7 * level
    out = smoothing.predict(smoothing.smooth(history(a=ys), 0.3), 3).orderBy("time_period").collect()
    assert [r["yhat"] for r in out] == pytest.approx([level] * 3)
    assert [str(r["time_period"].date()) for r in out] == ["2024-01-05", "2024-01-06", "2024-01-07"]


def test_trend_smoothing_follows_a_line(history):
    out = smoothing.forecast(history(a=[2.0 * i for i in range(40)]), holdout=10, horizon=15).orderBy("time_period")
    assert [r["yhat"] for r in out.collect()] == pytest.approx([2.0 * i for i in range(30, 45)])


def test_damping(history):
    state = smoothing.smooth(history(a=[0.0, 1.0]), alpha=0.5, beta=0.5, damping=0.5)
    row = state.first()
    ahead = [r["yhat"] for r in smoothing.predict(state, 2).orderBy("time_period").collect()]
    assert ahead == pytest.approx([row["level"] + 0.5 * row["trend"], row["level"] + 0.75 * row["trend"]])


def test_short_series_have_nothing_to_train_on(history):
    assert smoothing.forecast(history(a=[1.0, 2.0]), holdout=30).count() == 0


def test_trend_and_weekday(history):
    weekly = [0, 1, 2, 3, 4, -5, -5]
    ys = [10 + 0.5 * i + weekly[i % 7] for i in range(140)]
    out = trend.score(trend.fit(history(a=ys)), 7).orderBy("time_period").collect()
    want = [10 + 0.5 * i + weekly[i % 7] for i in range(140, 147)]
    # Weekday effects and the line are estimated one after the other, so they mix a little.
    assert [r["yhat"] for r in out] == pytest.approx(want, abs=0.6)


def test_one_point_series_is_flat(history):
    out = trend.predict(history(a=[4.0]), 2).collect()
    assert [r["yhat"] for r in out] == [4.0] * 3


def test_models_survive_storage(spark, history, folder):
    models = trend.fit(history(a=range(30), b=range(40)))
    trend.save_models(models, folder("models"))
    stored = trend.load_models(spark, folder("models"))
    assert sorted(map(str, trend.score(stored, 3).collect())) == sorted(map(str, trend.score(models, 3).collect()))
    since = trend.score_since(stored, history(c=range(35)), horizon=10)
    first = {r[0]: str(r[1].date()) for r in since.groupBy("series_key").agg(F.min("time_period")).collect()}
    assert first == {"a": "2024-02-04", "b": "2024-02-09"}


def test_fourier_fit_follows_a_noisy_sine(history):
    rng = np.random.default_rng(1)
    days = np.arange(100)
    ys = np.sin(2 * np.pi * days / 7) + 0.02 * days + rng.normal(scale=0.05, size=100)
    out = trend.fourier_predict(history(a=ys), 14, knots=3).orderBy("time_period").toPandas()
    assert len(out) == 114
    future = np.arange(100, 114)
    assert np.abs(out.yhat[100:] - (np.sin(2 * np.pi * future / 7) + 0.02 * future)).max() < 0.3


def test_known_coefficients(history):
    fits = arima.fit(history(a=ar(0.7, 600, 1), b=ar(-0.5, 600, 2)), [(1, 0, 0)])
    phi = {r["series_key"]: r["ar"][0] for r in fits.collect()}
    assert phi["a"] == pytest.approx(0.7, abs=0.08) and phi["b"] == pytest.approx(-0.5, abs=0.08)


def test_order_search(history):
    df = history(a=ar(0.7, 500, 4), b=np.cumsum(ar(0.0, 500, 5) - 20))
    best = {r["series_key"]: r for r in arima.best_orders(df).collect()}
    assert best["a"]["p"] >= 1
    assert all(np.isfinite(r["target"]) for r in best.values())


def test_forecast_returns_to_the_mean(history):
    out = arima.forecast(history(a=ar(0.7, 500, 6)), 30, [(1, 0, 0)]).orderBy("time_period").collect()
    assert len(out) == 30 and out[-1]["yhat"] == pytest.approx(20, abs=0.6)
    assert str(out[0]["time_period"].date()) == str(dt.date(2024, 1, 1) + dt.timedelta(days=500))


def test_differenced_forecast_continues_a_line(history):
    out = arima.forecast(history(a=[3.0 * i for i in range(60)]), 5, [(0, 2, 0)]).orderBy("time_period").collect()
    assert [r["yhat"] for r in out] == pytest.approx([3.0 * i for i in range(60, 65)], rel=1e-6)


def test_shared_order(history):
    df = history(a=ar(0.7, 300, 7), b=ar(-0.6, 300, 8))
    own = {r["series_key"]: (r["p"], r["d"], r["q"]) for r in arima.best_orders(df).collect()}
    shared = {r["series_key"]: (r["p"], r["d"], r["q"]) for r in arima.best_orders(df, order_from="b").collect()}
    assert set(shared.values()) == {own["b"]}
    first = {(r["p"], r["d"], r["q"]) for r in arima.best_orders(df, order_from="first").collect()}
    assert first == {own["a"]}


def test_failures_keep_their_rows(history):
    fits = arima.fit(history(a=[1.0, 2.0]), [(3, 1, 2)]).collect()
    assert [r["aic"] for r in fits] == [float("inf")]
    out = arima.forecast(history(a=[1.0, 2.0], b=ar(0.5, 100, 9)), 4, [(1, 0, 0)])
    assert out.filter("series_key = 'a' and yhat is null").count() == 4
    assert out.filter("series_key = 'b' and yhat is not null").count() == 4


def test_constant_series(history):
    out = arima.forecast(history(a=[5.0] * 60), 3).collect()
    assert [r["yhat"] for r in out] == pytest.approx([5.0] * 3)


def test_regressors(history):
    x = np.tile([0.0, 1.0, 5.0, 2.0], 50)
    df = history(a=4 + 2.5 * x + (ar(0.3, 200, 10) - 20) * 0.1)
    with_x = df.withColumn("x", F.element_at(F.array(*[F.lit(v) for v in (0.0, 1.0, 5.0, 2.0)]),
                                             F.datediff("time_period", F.lit("2024-01-01")) % 4 + 1))
    assert arima.fit(with_x, [(1, 0, 0)], exog=["x"]).first()["exog"][0] == pytest.approx(2.5, abs=0.05)


def test_forecast_with_regressors(spark, history):
    rng = np.random.default_rng(2)
    x = 50 + 10 * np.sin(np.arange(230))
    df = history(a=3 * x[:200] + rng.normal(scale=0.5, size=200))
    times = [(i, float(v)) for i, v in enumerate(x)]
    known = spark.createDataFrame(times, "i int, x double").select(
        F.expr("CAST(date_add(DATE'2024-01-01', i) AS TIMESTAMP_NTZ)").alias("time_period"), "x", "i")
    with_x = df.join(known.drop("i"), "time_period")
    future = known.filter("i >= 200").select(F.lit("a").alias("series_key"), "time_period", "x")
    out = arima.forecast(with_x, 30, [(1, 0, 0)], exog=["x"], future=future).orderBy("time_period").collect()
    assert [r["yhat"] for r in out] == pytest.approx(list(3 * x[200:]), abs=1.0)
    with pytest.raises(ValueError, match="go together"):
        arima.forecast(with_x, 30, [(1, 0, 0)], exog=["x"])
    short = arima.forecast(with_x, 30, [(1, 0, 0)], exog=["x"], future=future.limit(3)).collect()
    assert len(short) == 30 and all(r["yhat"] is None for r in short)


def test_default_orders_are_the_full_space():
    assert len(arima.candidates()) == 1083


def test_the_full_space():
    assert len(arima.candidates(arima.MAX_P, arima.MAX_D, arima.MAX_Q)) == 1083


def test_short_series_keep_the_orders_they_support(history):
    df = history(a=ar(0.7, 40, 11), b=ar(0.5, 12, 12), c=ar(0.7, 200, 13))
    best = {r["series_key"]: r for r in arima.best_orders(df).collect()}
    assert all(np.isfinite(best[k]["target"]) for k in "abc")
    out = arima.forecast(df, 3).collect()
    assert len(out) == 9 and all(r["yhat"] is not None for r in out)
    long, short = arima.reach_for(200, arima.candidates()), arima.reach_for(40, arima.candidates())
    assert (long, short) == (18, 10)
    y = ar(0.7, 40, 11)
    assert arima.fit_one(y, (short + 1, 0, 0), short) is None
    starts = {arima.fit_one(y, order, short)["start"] for order in [(0, 0, 0), (0, 1, 0), (0, 2, 0)]}
    assert len(starts) == 1


def test_a_lead_that_nothing_fits_shares_no_order(history):
    df = history(a=[1.0, 2.0, 3.0], b=ar(0.7, 300, 14), c=ar(-0.6, 300, 15))
    shared = {r["series_key"]: tuple(r)[1:] for r in arima.best_orders(df, order_from="first").collect()}
    own = {r["series_key"]: tuple(r)[1:] for r in arima.best_orders(df).collect()}
    assert shared == own and shared["b"][:3] != (0, 0, 0)
