"""ARIMA: exact likelihood beside a dense covariance, shared factorisations beside plain regressions."""

import numpy as np
import pytest

from visitgrain.forecast import arima
from visitgrain.forecast import likelihood as L


def autocovariances(ar, ma, n):
    """Of unit innovations, from a long moving average."""
    psi, ma = np.zeros(4000), np.r_[1.0, ma]
    for i in range(len(psi)):
        psi[i] = (ma[i] if i < len(ma) else 0) + sum(ar[k] * psi[i - 1 - k] for k in range(min(len(ar), i)))
    return np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])


def dense(x, ar, ma):
    n = len(x)
    g = autocovariances(ar, ma, n)
    cov = g[np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])]
    squares = x @ np.linalg.solve(cov, x)
    return n * (np.log(2 * np.pi * squares / n) + 1) + np.linalg.slogdet(cov)[1]


def simulated(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(5, n + 200):
        x[t] = e[t] + sum(a * x[t - 1 - k] for k, a in enumerate(ar)) + sum(b * e[t - 1 - k] for k, b in enumerate(ma))
    return x[200:]


CASES = [([0.6], []), ([], [0.5]), ([0.5, -0.3], [0.4]), ([0.3], [-0.5, 0.2]), ([], []), ([0.2, 0.1, 0.3], [])]


@pytest.mark.parametrize("ar,ma", CASES)
def test_equals_dense_covariance(ar, ma):
    x = simulated(ar, ma, 120, 1)
    for a, b in ((ar, ma), (np.multiply(ar, 0.5), np.multiply(ma, -0.7))):
        assert abs(L.minus_two_log(x, np.array(a), np.array(b)) - dense(x, a, b)) < 1e-7


def test_partial_autocorrelations_and_back():
    rng = np.random.default_rng(2)
    for k in range(6):
        r = rng.uniform(-0.95, 0.95, k)
        ar = L.from_partial(r)
        assert np.allclose(L.to_partial(ar), r) and arima._stationary(ar)


@pytest.mark.parametrize("ar,ma,d", [([0.6], [], 0), ([], [0.5], 0), ([0.5, -0.3], [0.4], 0), ([0.5], [0.3], 1)])
def test_maximum(ar, ma, d):
    x = simulated(ar, ma, 400, 3)
    y = np.cumsum(x) if d else x + 50
    start = arima.fit_one(y, (len(ar), d, len(ma)), 3)
    made = L.maximise(start)
    w = np.diff(y, d)
    mean = made["intercept"] / (1 - made["ar"].sum()) if not d else 0.0
    count = len(ar) + len(ma) + (d == 0) + 1
    value = dense(w - mean, made["ar"], made["ma"])
    assert abs(value + 2 * count - made["aic"]) < 1e-6
    rng = np.random.default_rng(4)
    for _ in range(40):  # nothing near it is better
        a, b = made["ar"] + rng.normal(0, 0.02, len(ar)), made["ma"] + rng.normal(0, 0.02, len(ma))
        assert L.minus_two_log(w - mean, a, b) >= value - 1e-3
    assert arima._stationary(made["ar"]) and arima._stationary(-made["ma"])
    assert np.allclose(made["ar"], ar, atol=0.15) and np.allclose(made["ma"], ma, atol=0.2)


def plain(y, order, reach):
    """The two regressions of one order, by least squares over written-out columns."""
    p, d, q = order
    w = np.diff(y, d)
    long_ar, start = max(reach, 1) + 2, max(reach, 1) + 2 + reach
    e = np.zeros(len(w))
    a = np.array([[1.0, *(w[t - k] for k in range(1, long_ar + 1))] for t in range(long_ar, len(w))])
    e[long_ar:] = w[long_ar:] - a @ np.linalg.lstsq(a, w[long_ar:], rcond=None)[0]
    x = np.array([[*([1.0] if d == 0 else []), *(w[t - k] for k in range(1, p + 1)), *(e[t - k] for k in range(1, q + 1))]
                  for t in range(start, len(w))]).reshape(len(w) - start, -1)
    coef = np.linalg.lstsq(x, w[start:], rcond=None)[0] if x.shape[1] else np.empty(0)
    rest = w[start:] - x @ coef
    return len(rest) * np.log(rest @ rest / len(rest)) + 2 * (len(coef) + 1), coef


def test_sampled_orders_equal_plain_regressions():
    rng = np.random.default_rng(5)
    y = 40 + simulated([0.5, 0.2], [0.3], 300, 6) * 3 + 5 * np.sin(np.arange(300) * 2 * np.pi / 7)
    fitter = arima.Fitter(y, 18)
    seen = 0
    for d in range(3):
        orders = [(int(rng.integers(19)), d, int(rng.integers(19))) for _ in range(12)] + [(0, d, 0), (18, d, 18), (0, d, 18), (18, d, 0)]
        for order in orders:
            aic, coef = plain(y, order, 18)
            made = fitter.fit(order)
            constant = int(d == 0)
            stable = arima._stationary(coef[constant : constant + order[0]]) and arima._stationary(-coef[constant + order[0] :])
            assert (made is not None) == stable
            if made:
                seen += 1
                assert abs(made["aic"] - aic) < 1e-8 * abs(aic)
                assert np.allclose(np.r_[made["ar"], made["ma"]], coef[constant:], atol=1e-6)
    assert seen > 10


def test_dependent_columns_fall_back():
    for y in (np.full(120, 7.0), np.arange(120.0), np.tile([1.0, 2.0], 60)):
        for order in ((0, 0, 0), (2, 0, 1), (1, 1, 1), (3, 2, 3)):
            made = arima.fit_one(y, order, 3)
            assert made is None or np.isfinite(made["aic"])


def test_exact_fit_over_series(spark, frame):
    rows = [(k, f"2020-01-{i:02d}" if i < 32 else f"2020-02-{i - 31:02d}", float(v)) for k, s in (("a", 7), ("b", 8))
            for i, v in enumerate(simulated([0.6], [], 59, s) + 9, 1)]
    df = frame(rows, "series_key string, time_period string, value double")
    for r in arima.fit(df, [(1, 0, 0), (0, 0, 1)], exact=True).collect():
        y = np.array([v for k, _, v in rows if k == r.series_key])
        mean = r.intercept / (1 - sum(r.ar))
        assert abs(dense(y - mean, r.ar, r.ma) + 2 * 3 - r.aic) < 1e-6
    out = arima.forecast(df, 5, [(1, 0, 0)], exact=True).collect()
    assert len(out) == 10 and all(r.yhat is not None for r in out)
