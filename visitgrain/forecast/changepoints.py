"""A trend of few breaks: lasso over many possible changepoints, with seasons, and simulated bounds.

The trend is a line whose slope may change at each of ``knots`` days spread over the first four fifths of
a series; the changes have an absolute-value penalty, so most of them are exactly zero. Line and
seasonal waves are not penalised: they are projected out, coordinate descent finds the changes on what
is left, and least squares gives the rest. Times run from 0 to 1 over the history and values are divided by their
greatest, so one ``scale`` (the size of change held plausible) suits every series; the penalty is the
variance of the unpenalised fit over ``scale``.

Bounds come from simulated futures: slopes go on changing as often as knots stand in the history, by
double exponential steps of the mean size found, around which the fit's noise is drawn. The seed is
fixed for each series, so a run that is repeated gives the same bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from visitgrain.forecast.series import KEY, VALUE, series_arrays
from visitgrain.operators.resample import PERIOD

KNOTS, SCALE, SAMPLES, INTERVAL = 25, 0.05, 300, 0.8

_FITTED = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField(PERIOD, T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("trend", "yhat", "yhat_lower", "yhat_upper")]
)
_BREAKS = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField(PERIOD, T.TimestampNTZType()), T.StructField("slope_change", T.DoubleType())]
)


def lasso(gram: np.ndarray, along: np.ndarray, penalty: float, rounds: int = 5000, least: float = 1e-12) -> np.ndarray:
    """Least 1/2 d'gram d - along'd + penalty * sum|d|, by coordinate descent."""
    d, left = np.zeros(len(along)), along.astype(float).copy()  # left: along - gram d
    for _ in range(rounds):
        most = 0.0
        for j in range(len(d)):
            if gram[j, j] <= 0:
                continue
            pull = left[j] + gram[j, j] * d[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / gram[j, j]
            if new != d[j]:
                left -= gram[:, j] * (new - d[j])
                most = max(most, abs(new - d[j]) * np.sqrt(gram[j, j]))
                d[j] = new
        if most < least:
            break
    return d


def _waves(days: np.ndarray, yearly: int, weekly: int) -> np.ndarray:
    made = [f(2 * np.pi * k * days / width) for width, order in ((365.25, yearly), (7.0, weekly))
            for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.column_stack(made) if made else np.empty((len(days), 0))


def fit_one(days: np.ndarray, y: np.ndarray, knots: int, scale: float | None, yearly: int, weekly: int) -> dict:
    """Coefficients over scaled time and values; ``scale`` None lays no penalty."""
    first, span = days[0], max(days[-1] - days[0], 1.0)
    t, top = (days - first) / span, max(float(np.abs(y).max()), 1e-12)
    at = np.linspace(0, 0.8, knots + 2)[1:-1]
    free = np.column_stack([np.ones_like(t), t, _waves(days, yearly, weekly)])
    hinges, target = np.maximum(t[:, None] - at, 0), y / top
    basis, factor, _ = np.linalg.svd(free, full_matrices=False)
    basis = basis[:, factor > 1e-10 * factor[0]]
    own, rest = hinges - basis @ (basis.T @ hinges), target - basis @ (basis.T @ target)
    unpenalised = np.linalg.lstsq(own, rest, rcond=1e-10)[0] if knots else np.empty(0)
    degrees = max(len(t) - basis.shape[1] - knots, 1)
    variance = float(np.sum((rest - own @ unpenalised) ** 2)) / degrees
    change = unpenalised if scale is None else lasso(own.T @ own, own.T @ rest, variance / scale)
    line = np.linalg.lstsq(free, target - hinges @ change, rcond=None)[0]
    noise = float(np.std(target - free @ line - hinges @ change))
    return {"first": first, "span": span, "top": top, "at": at, "change": change, "line": line, "noise": noise}


def _trend(model: dict, t: np.ndarray) -> np.ndarray:
    return model["line"][0] + model["line"][1] * t + np.maximum(t[:, None] - model["at"], 0) @ model["change"]


def simulate(model: dict, ahead: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Departures from the trend at scaled times after 1: one row per sample, noise included."""
    rng = np.random.default_rng(seed)
    steps = np.diff(np.r_[1.0, ahead])
    size = float(np.mean(np.abs(model["change"]))) if len(model["change"]) else 0.0
    often = np.minimum(len(model["change"]) * steps, 1.0)
    changes = (rng.random((samples, len(ahead))) < often) * rng.laplace(0.0, 1.0, (samples, len(ahead))) * size
    # A slope that changes at the start of a step acts over that step and all later ones.
    away = np.cumsum(np.cumsum(changes, axis=1) * steps, axis=1)
    return away + rng.normal(0.0, model["noise"], away.shape)


def _arrays(history: DataFrame) -> DataFrame:
    return series_arrays(history).select(
        F.col(KEY).cast("string").alias(KEY), F.col(f"points.{PERIOD}").alias("times"), F.col(f"points.{VALUE}").alias("values")
    )


_EPOCH = np.datetime64("1970-01-01")


def _days(times) -> np.ndarray:
    return (np.asarray(times, "datetime64[ns]").astype("datetime64[D]") - _EPOCH).astype(float)


def _stamps(days: np.ndarray) -> np.ndarray:
    return (_EPOCH + np.round(days).astype("timedelta64[D]")).astype("datetime64[ns]")


def predict(
    history: DataFrame,
    horizon: int = 30,
    knots: int = KNOTS,
    scale: float | None = SCALE,
    yearly: int = 0,
    weekly: int = 3,
    samples: int = SAMPLES,
    interval: float = INTERVAL,
    seed: int = 0,
) -> DataFrame:
    """(series_key, time_period, trend, yhat, yhat_lower, yhat_upper) over the history and ``horizon`` days more.

    The bounds hold ``interval`` of the simulated futures; over the history they hold that much of the fit's noise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, times, values in zip(batch[KEY], batch["times"], batch["values"]):
                days = _days(times)
                model = fit_one(days, np.asarray(values, float), knots, scale, yearly, weekly)
                every = np.r_[days, days[-1] + np.arange(1, horizon + 1)]
                t = (every - model["first"]) / model["span"]
                trend = _trend(model, t)
                yhat = trend + _waves(every, yearly, weekly) @ model["line"][2:]
                mark = seed + zlib.crc32(str(key).encode())
                inside = np.random.default_rng(mark + 1).normal(0.0, model["noise"], (samples, 1)) * np.ones((1, len(days)))
                away = np.hstack([inside, simulate(model, t[len(days):], samples, mark)])
                low, high = np.quantile(away, [(1 - interval) / 2, (1 + interval) / 2], axis=0)
                made = [trend, yhat, yhat + low, yhat + high]
                yield pd.DataFrame({KEY: key, PERIOD: _stamps(every), **{f.name: m * model["top"] for f, m in zip(_FITTED.fields[2:], made)}})

    return _arrays(history).mapInPandas(run, _FITTED)


def breaks(history: DataFrame, knots: int = KNOTS, scale: float | None = SCALE, yearly: int = 0, weekly: int = 3) -> DataFrame:
    """(series_key, time_period, slope_change per day) of the changes that are not zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, times, values in zip(batch[KEY], batch["times"], batch["values"]):
                m = fit_one(_days(times), np.asarray(values, float), knots, scale, yearly, weekly)
                some = m["change"] != 0
                at = m["first"] + m["at"][some] * m["span"]
                yield pd.DataFrame({KEY: key, PERIOD: _stamps(at), "slope_change": m["change"][some] * m["top"] / m["span"]})

    return _arrays(history).mapInPandas(run, _BREAKS)
