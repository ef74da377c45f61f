"""Trend and seasonality models: one aggregate fits every series; a table holds the models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from visitgrain.forecast.series import KEY, VALUE, future_periods, series_arrays
from visitgrain.functions.dates import weekday
from visitgrain.operators.resample import PERIOD

ORIGIN = "2000-01-01"


def _day(ts: Column) -> Column:
    """Days since a fixed origin, the trend's regressor."""
    return F.datediff(ts, F.lit(ORIGIN).cast("date")).cast("double")


def fit(history: DataFrame) -> DataFrame:
    """Least-squares line plus mean residual per weekday, for every series at once.

    Moments per (series, weekday) are summed first; the line and all seven effects follow from
    them, so the history is read once.
    """
    x, y = _day(F.col(PERIOD)), F.col(VALUE)
    moments = (
        history.filter(y.isNotNull())
        .groupBy(KEY, weekday(PERIOD).alias("wd"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
            F.min(PERIOD).alias("first_time"), F.max(PERIOD).alias("last_time"),
        )
    )
    totals = moments.groupBy(KEY).agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")],
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.collect_list(F.struct("wd", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my")))
        .alias("weekdays"),
    )
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.coalesce(
        F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), spread), F.lit(0.0)
    )
    lined = totals.withColumn("slope", slope).withColumn(
        "intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")
    )
    effects = F.map_from_entries(
        F.transform(
            "weekdays",
            lambda w: F.struct(w["wd"], w["my"] - (F.col("intercept") + F.col("slope") * w["mx"])),
        )
    )
    return lined.select(
        KEY, F.col("n").cast("long").alias("n"), "intercept", "slope", effects.alias("effects"),
        "first_time", "last_time",
    )


def save_models(models: DataFrame, path: str, mode: str = "overwrite") -> None:
    models.write.mode(mode).parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _evaluate(rows: DataFrame) -> DataFrame:
    effect = F.coalesce(F.try_element_at("effects", weekday(PERIOD)), F.lit(0.0))
    yhat = F.col("intercept") + F.col("slope") * _day(F.col(PERIOD)) + effect
    return rows.select(KEY, PERIOD, yhat.alias("yhat"))


def score(models: DataFrame, horizon: int = 30) -> DataFrame:
    """The ``horizon`` days after each model's last observation."""
    return _evaluate(
        models.withColumn(PERIOD, F.explode(future_periods(F.col("last_time"), horizon)))
    )


def score_since(models: DataFrame, history: DataFrame, horizon: int = 30) -> DataFrame:
    """Stored models over their own span and ``horizon`` further days, from the last day of
    ``history`` on (that day included)."""
    newest = history.agg(F.max(PERIOD).alias("t")).scalar()
    future = models.select(
        "*",
        F.explode(
            F.concat(F.array("last_time"), future_periods(F.col("last_time"), horizon))
        ).alias(PERIOD),
    )
    return _evaluate(future.filter(F.col(PERIOD) >= newest))


def predict(history: DataFrame, horizon: int) -> DataFrame:
    """Fitted values over the observed span and ``horizon`` days more."""
    models = fit(history)
    span = F.sequence(F.col("first_time"), F.col("last_time"), F.expr("INTERVAL 1 DAY"))
    days = F.concat(span, future_periods(F.col("last_time"), horizon))
    return _evaluate(models.withColumn(PERIOD, F.explode(days)))


# --- richer fit: piecewise trend with yearly and weekly Fourier terms, ridge regression ---

_FITTED = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField(PERIOD, T.TimestampNTZType()),
        T.StructField("trend", T.DoubleType()),
        T.StructField("weekly", T.DoubleType()),
        T.StructField("yhat", T.DoubleType()),
        T.StructField("yhat_lower", T.DoubleType()),
        T.StructField("yhat_upper", T.DoubleType()),
    ]
)

#: Standard deviations on either side that hold nine tenths of a normal distribution.
_NINE_TENTHS = 1.6448536269514722


def _features(days: np.ndarray, first: float, last: float, knots: int, yearly: int, weekly: int):
    t = (days - first) / max(last - first, 1.0)
    # Knots lie in the first four fifths, so that the final slope is well supported.
    at = np.linspace(0, 0.8, knots + 2)[1:-1]
    trend = np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0) for k in at]])
    waves = [
        f(2 * np.pi * k * days / width)
        for width, order in ((365.25, yearly), (7.0, weekly))
        for k in range(1, order + 1)
        for f in (np.sin, np.cos)
    ]
    return trend, np.column_stack(waves) if waves else np.empty((len(t), 0))


def _ridge_predict(times: np.ndarray, y: np.ndarray, horizon: int, knots: int, yearly: int, weekly: int):
    """Trend and prediction for the observed days and ``horizon`` following ones."""
    origin = np.datetime64("1970-01-01")
    days = (times.astype("datetime64[D]") - origin).astype(float)
    ahead = days[-1] + np.arange(1, horizon + 1)
    every = np.concatenate([days, ahead])
    trend, waves = _features(every, days[0], days[-1], knots, yearly, weekly)
    x = np.hstack([trend, waves])
    n, scale = len(days), max(float(np.abs(y).max()), 1e-12)
    penalty = np.full(x.shape[1], 1.0)
    penalty[:2] = 1e-8
    penalty[trend.shape[1]:] = 0.01
    a = x[:n]
    beta = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ (y / scale)) * scale
    split = trend.shape[1]
    line, week = trend @ beta[:split], waves[:, 2 * yearly :] @ beta[split + 2 * yearly :]
    stamps, yhat = origin + every.astype("timedelta64[D]"), x @ beta
    spread = _NINE_TENTHS * float(np.sqrt(np.mean((y - yhat[:n]) ** 2)))
    return stamps.astype("datetime64[ns]"), line, week, yhat, yhat - spread, yhat + spread


def fourier_predict(
    history: DataFrame, horizon: int, knots: int = 25, yearly: int = 0, weekly: int = 3
) -> DataFrame:
    """One small solve per series: (series_key, time_period, trend, weekly, yhat, yhat_lower, yhat_upper)
    over history and future.

    ``yearly`` is the number of yearly waves; it is for the caller to ask for them, with a history
    of two years or more. The bounds hold nine of ten residuals of the fit if they are normal.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, times, values in zip(batch[KEY], batch["times"], batch["values"]):
                made = _ridge_predict(
                    np.asarray(times, dtype="datetime64[ns]"), np.asarray(values, dtype=float),
                    horizon, knots, yearly, weekly,
                )
                yield pd.DataFrame({KEY: key, **dict(zip(_FITTED.names[1:], made))})

    arrays = series_arrays(history).select(
        F.col(KEY).cast("string").alias(KEY),
        F.col(f"points.{PERIOD}").alias("times"), F.col(f"points.{VALUE}").alias("values"),
    )
    return arrays.mapInPandas(run, _FITTED)
