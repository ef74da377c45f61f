"""Exponential smoothing as expressions over each series' array; no Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.forecast.series import KEY, VALUE, future_periods, series_arrays
from visitgrain.operators.resample import PERIOD

DEFAULT_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def _state(points: Column, alpha: Column, beta: Column, damping: Column) -> Column:
    """Fold the points into (level, trend, squared one-step error).

    The first point sets the level; the first difference sets the trend where ``beta`` is used.
    """
    first = points[0][VALUE]
    slope = F.when(
        (beta > 0) & (F.size(points) > 1), F.get(points, F.lit(1))[VALUE] - first
    ).otherwise(F.lit(0.0))
    start = F.struct(first.alias("level"), slope.alias("trend"), F.lit(0.0).alias("sse"))

    def absorb(s: Column, p: Column) -> Column:
        expected = s["level"] + damping * s["trend"]
        level = alpha * p[VALUE] + (1 - alpha) * expected
        trend = beta * (level - s["level"]) + (1 - beta) * damping * s["trend"]
        error = p[VALUE] - expected
        return F.struct(
            level.alias("level"), trend.alias("trend"), (s["sse"] + error * error).alias("sse")
        )

    return F.aggregate(F.slice(points, F.lit(2), F.size(points)), start, absorb)


def _train(history: DataFrame, holdout: int) -> DataFrame:
    """Series without their last ``holdout`` points; a series with nothing left is dropped."""
    arrays = series_arrays(history).filter(F.size("points") > holdout)
    return arrays.withColumn(
        "points", F.slice("points", F.lit(1), F.size("points") - F.lit(holdout))
    )


def _fold(train: DataFrame) -> DataFrame:
    return train.withColumn("s", _state(F.col("points"), F.col("alpha"), F.col("beta"), F.col("damping")))


def smooth(
    history: DataFrame, alpha: float, beta: float = 0.0, damping: float = 1.0, holdout: int = 0
) -> DataFrame:
    """Final level and trend per series for given parameters; ``beta=0`` is simple smoothing."""
    given = {"alpha": alpha, "beta": beta, "damping": damping}
    train = _train(history, holdout).withColumns({k: F.lit(float(v)) for k, v in given.items()})
    return _fold(train).select(
        KEY, "alpha", "beta", "damping",
        F.col("s.level").alias("level"), F.col("s.trend").alias("trend"), F.col("s.sse").alias("sse"),
        F.element_at("points", -1)[PERIOD].alias("last_time"),
    )


def fit(
    history: DataFrame,
    holdout: int = 0,
    alphas: Sequence[float] = DEFAULT_GRID,
    betas: Sequence[float] = (0.0, *DEFAULT_GRID),
    damping: float = 1.0,
) -> DataFrame:
    """Per series the grid parameters with the least squared one-step error."""
    # Candidates multiply rows inside the task; only their scores reach the shuffle.
    tried = _fold(
        _train(history, holdout)
        .withColumn("alpha", F.explode(F.lit([float(a) for a in alphas])))
        .withColumn("beta", F.explode(F.lit([float(b) for b in betas])))
        .withColumn("damping", F.lit(float(damping)))
    )
    best = F.min(
        F.struct(
            F.col("s.sse").alias("sse"), "alpha", "beta", "damping",
            F.col("s.level").alias("level"), F.col("s.trend").alias("trend"),
            F.element_at("points", -1)[PERIOD].alias("last_time"),
        )
    )
    return tried.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.*")


def predict(states: DataFrame, horizon: int = 90, freq: str = "D") -> DataFrame:
    """(series_key, time_period, yhat) for the buckets after each series' last point."""
    ahead = states.select(
        "*", F.posexplode(future_periods(F.col("last_time"), horizon, freq)).alias("h", PERIOD)
    )
    steps = F.col("h") + 1
    d = F.col("damping")
    damped = F.when(d == 1.0, steps.cast("double")).otherwise(d * (1 - F.pow(d, steps)) / (1 - d))
    return ahead.select(KEY, PERIOD, (F.col("level") + damped * F.col("trend")).alias("yhat"))


def forecast(history: DataFrame, holdout: int = 30, horizon: int = 90, freq: str = "D", **grid) -> DataFrame:
    """Fit without the last ``holdout`` points and predict ``horizon`` buckets from there."""
    return predict(fit(history, holdout, **grid), horizon, freq)


# --- additive season ---


def _seasonal_state(points: Column, season: int, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Fold the points into (level, trend, seasonal terms, squared one-step error).

    The first season sets the level (its mean) and the terms, the second the trend. The terms stand
    in the order in which they are next used, so a step takes the first and puts its successor last.
    """
    y = F.transform(points, lambda p: p[VALUE])
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    first, second = F.slice(y, 1, season), F.slice(y, season + 1, season)
    level = total(first) / season
    start = F.struct(
        level.alias("level"),
        ((total(second) - total(first)) / (season * season)).alias("trend"),
        F.transform(first, lambda x: x - level).alias("terms"),
        F.lit(0.0).alias("sse"),
    )

    def absorb(s: Column, value: Column) -> Column:
        base, term = s["level"] + s["trend"], s["terms"][0]
        now = alpha * (value - term) + (1 - alpha) * base
        error = value - (base + term)
        later = gamma * (value - now) + (1 - gamma) * term
        return F.struct(
            now.alias("level"),
            (beta * (now - s["level"]) + (1 - beta) * s["trend"]).alias("trend"),
            F.concat(F.slice(s["terms"], 2, season - 1), F.array(later)).alias("terms"),
            (s["sse"] + error * error).alias("sse"),
        )

    return F.aggregate(F.slice(y, F.lit(season + 1), F.size(y)), start, absorb)


def smooth_seasonal(
    history: DataFrame,
    season: int,
    alphas: Sequence[float] = DEFAULT_GRID,
    betas: Sequence[float] = (0.0, 0.1, 0.3),
    gammas: Sequence[float] = (0.1, 0.3, 0.5),
    holdout: int = 0,
) -> DataFrame:
    """Level, trend and ``season`` additive terms per series, with the grid parameters of least squared error.

    A series needs two whole seasons; one that is shorter is dropped.
    """
    if season < 2:
        raise ValueError("season must be 2 or more")
    tried = _train(history, holdout).filter(F.size("points") >= 2 * season)
    for name, values in (("alpha", alphas), ("beta", betas), ("gamma", gammas)):
        tried = tried.withColumn(name, F.explode(F.lit([float(v) for v in values])))
    made = tried.withColumn("s", _seasonal_state(F.col("points"), season, F.col("alpha"), F.col("beta"), F.col("gamma")))
    best = F.min(
        F.struct(
            F.col("s.sse").alias("sse"), "alpha", "beta", "gamma", F.col("s.level").alias("level"),
            F.col("s.trend").alias("trend"), F.col("s.terms").alias("terms"), F.element_at("points", -1)[PERIOD].alias("last_time"),
        )
    )
    return made.groupBy(KEY).agg(best.alias("b")).select(KEY, "b.*")


def predict_seasonal(states: DataFrame, horizon: int = 90, freq: str = "D") -> DataFrame:
    """(series_key, time_period, yhat) for the buckets after each series' last point."""
    ahead = states.select("*", F.posexplode(future_periods(F.col("last_time"), horizon, freq)).alias("h", PERIOD))
    term = F.get("terms", F.col("h") % F.size("terms"))
    return ahead.select(KEY, PERIOD, (F.col("level") + (F.col("h") + 1) * F.col("trend") + term).alias("yhat"))


def forecast_seasonal(
    history: DataFrame, season: int = 7, holdout: int = 30, horizon: int = 90, freq: str = "D", **grid
) -> DataFrame:
    """Seasonal smoothing without the last ``holdout`` points, and ``horizon`` buckets from there."""
    return predict_seasonal(smooth_seasonal(history, season, holdout=holdout, **grid), horizon, freq)
