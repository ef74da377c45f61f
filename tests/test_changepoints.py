"""Sparse changepoints: made broken lines, conditions of the lasso's optimum, simulated bounds."""

import datetime as dt

import numpy as np
import pytest

from visitgrain.forecast import changepoints as C

START = dt.datetime(2020, 1, 1)


@pytest.fixture
def history(spark):
    def make(**series):
        rows = [(k, START + dt.timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
        return spark.createDataFrame(rows, "series_key string, time_period timestamp_ntz, value double")

    return make


def broken(n=400, at=200, noise=0.3, seed=1):
    t = np.arange(n)
    return 50 + 0.1 * t - 0.3 * np.maximum(t - at, 0) + np.random.default_rng(seed).normal(0, noise, n)


def test_broken_line_recovers_its_knot(spark, history):
    out = C.breaks(history(a=broken()), weekly=0).toPandas()
    large = out[abs(out.slope_change) > 0.05]
    assert len(out) < 12 and 1 <= len(large) <= 3 and abs(large.slope_change.sum() + 0.3) < 0.06
    assert all(abs((t - START).days - 200) <= 20 for t in large.time_period)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(2)
    for penalty in (0.0, 0.5, 5.0, 1e6):
        x, y = rng.normal(size=(80, 12)), rng.normal(size=80)
        d = C.lasso(x.T @ x, x.T @ y, penalty)
        pull = x.T @ (y - x @ d)
        assert np.all(np.abs(pull) <= penalty + 1e-6) and np.allclose(pull[d != 0], penalty * np.sign(d[d != 0]), atol=1e-6)
        if penalty == 0:
            assert np.allclose(d, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


def test_without_penalty_equals_least_squares():
    y, days = broken(), np.arange(400.0)
    m = C.fit_one(days, y, 3, None, 0, 2)
    t = days / 399
    x = np.column_stack([np.ones(400), t, np.maximum(t[:, None] - m["at"], 0), C._waves(days, 0, 2)])
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = (C._trend(m, t) + C._waves(days, 0, 2) @ m["line"][2:]) * m["top"]
    assert np.allclose(got, want, atol=1e-8)


def test_bounds(spark, history):
    df = history(a=broken(), b=broken(noise=0.0), c=[5.0] * 20, d=[3.0])
    out = C.predict(df, 60).toPandas()
    a = out[out.series_key == "a"].sort_values("time_period")
    assert len(a) == 460 and (a.yhat_lower <= a.yhat_upper).all()
    width = (a.yhat_upper - a.yhat_lower).to_numpy()
    assert width[-1] > width[399] > 0  # the future is less certain the further it is
    inside = ((a.yhat_lower <= a.yhat) & (a.yhat <= a.yhat_upper)).mean()
    assert inside > 0.95
    share = ((broken() >= a.yhat_lower[:400]) & (broken() <= a.yhat_upper[:400])).mean()
    assert 0.7 < share < 0.9
    again = C.predict(df, 60).toPandas()
    key = ["series_key", "time_period"]
    assert again.sort_values(key).reset_index(drop=True).equals(out.sort_values(key).reset_index(drop=True))
    flat = out[out.series_key == "c"]
    assert np.allclose(flat.yhat, 5.0) and np.allclose(flat.yhat_upper, 5.0)
    assert len(out[out.series_key == "d"]) == 61
