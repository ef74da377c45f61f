"""ARIMA for many series: candidate orders are fitted in parallel, the least AIC wins.

Each fit is two least-squares regressions (Hannan and Rissanen, 1982): a long autoregression
estimates the innovations, then the series is regressed on its own lags and theirs.

The orders of a series share their work. The long autoregression and the innovations belong to
(series, d). The columns of order (p, q) are the first p lags of the series and the first q of the
innovations, so one QR factorisation of all lags of the series holds every p, and for each p one of the
innovations' lags, less their part in those of the series, holds every q: 20 factorisations
instead of 361 regressions for each d. ``fit(…, exact=True)`` maximises the exact likelihood from there
(``likelihood``).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from visitgrain.forecast.likelihood import maximise, minus_two_log
from visitgrain.forecast.series import KEY, VALUE, future_periods, series_arrays
from visitgrain.operators.resample import PERIOD

Order = tuple[int, int, int]

# Bounds of the full search space.
MAX_P, MAX_D, MAX_Q = 18, 2, 18

_FIT = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("p", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("q", T.IntegerType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("ar", T.ArrayType(T.DoubleType())),
        T.StructField("ma", T.ArrayType(T.DoubleType())),
        T.StructField("exog", T.ArrayType(T.DoubleType())),
    ]
)

_AHEAD = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("p", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("q", T.IntegerType()),
        T.StructField("ahead", T.ArrayType(T.DoubleType())),
        T.StructField("last_time", T.TimestampNTZType()),
    ]
)


def candidates(max_p: int = MAX_P, max_d: int = MAX_D, max_q: int = MAX_Q) -> list[Order]:
    """Every order up to the given bounds; without any, the full space of 1,083."""
    return [
        (p, d, q) for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)
    ]


def _lags(x: np.ndarray, n: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - k : len(x) - k] for k in range(1, n + 1)]) if n else np.empty((len(x) - start, 0))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _stationary(ar: np.ndarray) -> bool:
    return len(ar) == 0 or bool(np.all(np.abs(np.roots(np.r_[1.0, -ar])) < 1.0))


#: A diagonal entry of a factor this small beside the largest means a column that depends on others.
_DEPENDENT = 1e-9


class Fitter:
    """All orders of one series. ``reach`` is the longest lag its candidates may have (``reach_for``):
    every candidate of one ``d`` is scored on the same observations, which is what makes their AIC
    comparable. An order of longer lags has no fit, nor one that those observations are too few for.
    """

    def __init__(self, y: np.ndarray, reach: int, exog: np.ndarray | None = None):
        self.reach, self.beta = reach, np.empty(0)
        if exog is not None and exog.size:
            design = np.column_stack([np.ones(len(y)), exog])
            self.beta = _solve(design, y)[1:]
            y = y - exog @ self.beta
        self.y = y
        self.long_ar = max(reach, 1) + 2
        self.start = self.long_ar + reach
        self._columns, self._series, self._noise = {}, {}, {}

    def _of(self, d: int) -> tuple:
        """Differenced series, its lags (after a constant, where there is one), the innovations' lags, the target."""
        if d not in self._columns:
            w, long_ar, start = np.diff(self.y, d), self.long_ar, self.start
            innovations = np.zeros_like(w)
            a = np.column_stack([np.ones(len(w) - long_ar), _lags(w, long_ar, long_ar)])
            innovations[long_ar:] = w[long_ar:] - a @ _solve(a, w[long_ar:])
            own = np.column_stack([np.ones((len(w) - start, int(d == 0))), _lags(w, self.reach, start)])
            self._columns[d] = (w, own, _lags(innovations, self.reach, start), w[start:])
        return self._columns[d]

    def _factors(self, p: int, d: int) -> tuple:
        """Factors of the first ``p`` lags of the series, and of the innovations' lags beside them."""
        if (p, d) not in self._noise:
            _, own, noise, target = self._of(d)
            if d not in self._series:
                self._series[d] = np.linalg.qr(own)
            q_all, r_all = self._series[d]
            k = p + int(d == 0)
            q_own = q_all[:, :k]
            across, onto = q_own.T @ noise, q_own.T @ target
            q_rest, r_rest = np.linalg.qr(noise - q_own @ across)
            self._noise[p, d] = (r_all[:k, :k], across, onto, r_rest, q_rest.T @ (target - q_own @ onto))
        return self._noise[p, d]

    def _coefficients(self, p: int, d: int, q: int) -> np.ndarray:
        _, own, noise, target = self._of(d)
        k = p + int(d == 0)
        if own.shape[0] > own.shape[1] + noise.shape[1]:
            r_own, across, onto, r_rest, along = self._factors(p, d)
            diagonal = np.abs(np.r_[np.diag(r_own), np.diag(r_rest)[:q]])
            norms = np.r_[np.linalg.norm(own[:, :k], axis=0), np.linalg.norm(noise[:, :q], axis=0)]
            if np.all(diagonal > _DEPENDENT * np.maximum(norms, np.finfo(float).tiny)):
                late = np.linalg.solve(r_rest[:q, :q], along[:q]) if q else np.empty(0)
                early = np.linalg.solve(r_own, onto - across[:, :q] @ late) if k else np.empty(0)
                return np.r_[early, late]
        x = np.column_stack([own[:, :k], noise[:, :q]])
        return _solve(x, target) if x.shape[1] else np.empty(0)

    def fit(self, order: Order) -> dict | None:
        """Coefficients and AIC of one order, or None when it cannot be fitted."""
        p, d, q = order
        constant = 1 if d == 0 else 0
        if max(p, q) > self.reach or len(self.y) - d - self.start <= max(p + q + constant, self.long_ar) + 1:
            return None
        w, own, noise, target = self._of(d)
        coef = self._coefficients(p, d, q)
        residual = target - own[:, : p + constant] @ coef[: p + constant] - noise[:, :q] @ coef[p + constant :]
        variance = float(residual @ residual) / len(target)
        ar, ma = coef[constant : constant + p], coef[constant + p :]
        if not np.isfinite(variance) or not _stationary(ar) or not _stationary(-ma):
            return None
        # A constant series is predicted exactly; the floor keeps its score finite.
        fit_term = len(target) * float(np.log(max(variance, np.finfo(float).tiny)))
        return {
            "aic": fit_term + 2 * (len(coef) + len(self.beta) + 1),
            "intercept": float(coef[0]) if constant else 0.0,
            "ar": ar, "ma": ma, "exog": self.beta, "start": self.start, "w": w, "y": self.y,
        }


def fit_one(y: np.ndarray, order: Order, reach: int, exog: np.ndarray | None = None) -> dict | None:
    return Fitter(y, reach, exog).fit(order)


def forecast_one(model: dict, d: int, horizon: int) -> np.ndarray:
    """Iterate the fitted equation, then undo the differencing."""
    w, ar, ma = model["w"], model["ar"], model["ma"]
    errors = np.zeros(len(w))
    for t in range(max(len(ar), len(ma)), len(w)):
        past = model["intercept"] + ar @ w[t - len(ar) : t][::-1] + ma @ errors[t - len(ma) : t][::-1]
        errors[t] = w[t] - past
    values, noise = list(w), list(errors)
    for _ in range(horizon):
        a = np.asarray(values[len(values) - len(ar) :])[::-1]
        m = np.asarray(noise[len(noise) - len(ma) :])[::-1]
        values.append(float(model["intercept"] + ar @ a + ma @ m))
        noise.append(0.0)
    ahead = np.asarray(values[len(w) :])
    for level in range(d - 1, -1, -1):
        ahead = np.cumsum(ahead) + np.diff(model["y"], level)[-1]
    return ahead


def reach_of(orders: Sequence[Order]) -> int:
    return max(max(p, q) for p, _, q in orders)


def reach_for(n: int, orders: Sequence[Order]) -> int:
    """The longest lag that ``n`` observations support, ``reach_of`` at most: with it the smallest
    candidate of every ``d`` can still be fitted. 0 where there is no such lag."""
    most = max(d for _, d, _ in orders)
    fits = (r for r in range(reach_of(orders), 0, -1) if n - most - (r + 2) - r > r + 3)
    return next(fits, 0)


def _spread(history: DataFrame, exog: Sequence[str]) -> DataFrame:
    """One row per series: key, ``values_``, ``last_time`` and regressors ``x0``, ``x1``, …"""
    return series_arrays(history, exog).select(
        F.col(KEY).cast("string").alias("key"),
        F.col(f"points.{VALUE}").alias("values_"),
        F.element_at(f"points.{PERIOD}", -1).alias("last_time"),
        *[F.col(f"points.{c}").alias(f"x{i}") for i, c in enumerate(exog)],
    )


def _regressors(row, n: int, prefix: str = "x") -> np.ndarray | None:
    return np.column_stack([np.asarray(getattr(row, f"{prefix}{i}"), float) for i in range(n)]) if n else None


def fit(
    history: DataFrame,
    orders: Sequence[Order],
    exog: Sequence[str] = (),
    chunk: int = 361,
    among: Sequence[Order] | None = None,
    exact: bool = False,
) -> DataFrame:
    """Every series fitted with every order: one row each, ``aic`` infinite where that failed.

    A series' orders are scored on one window, as long as its own length allows. With ``among``,
    the candidates that ``orders`` were chosen from, the window is theirs, or that of the order's own lags
    where these are longer.

    With ``exact`` the coefficients maximise the exact likelihood of the whole differenced series, and ``aic`` is of it.

    A series is short (one value per bucket), so its array is repeated per chunk of orders and
    the (series, chunk) pairs are spread over all tasks. Orders are dealt by ``d`` first, since those of one
    ``d`` share their work.
    """
    orders = sorted(orders, key=lambda o: (o[1], o[0], o[2]))
    scored = orders if among is None else list(among)
    chunks = [orders[i : i + chunk] for i in range(0, len(orders), chunk)]
    n = len(exog)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                y, x = np.asarray(row.values_, dtype=float), _regressors(row, n)
                reach, fitters = reach_for(len(y), scored), {}
                for order in chunks[row.chunk]:
                    most = reach if among is None else max(reach, order[0], order[2])
                    if most not in fitters:
                        fitters[most] = Fitter(y, most, x)
                    model = fitters[most].fit(order)
                    if exact and model is not None:
                        model |= maximise(model)
                    if model is None:
                        out.append((row.key, *order, float("inf"), None, None, None, None))
                    else:
                        out.append((row.key, *order, *(model[k] for k in ("aic", "intercept", "ar", "ma", "exog"))))
            yield pd.DataFrame(out, columns=_FIT.names)

    tasks = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))).alias("chunk")
    return _spread(history, exog).select("*", each).repartition(tasks, "key", "chunk").mapInPandas(run, _FIT)


def likelihoods(history: DataFrame, models: Mapping[str, tuple[Sequence[float], Sequence[float]]]) -> DataFrame:
    """(series_key, model, minus_two_log): the exact likelihood of each centred series at given (ar, ma)
    coefficients, the variance at its best value."""
    named = {k: (np.asarray(ar, float), np.asarray(ma, float)) for k, (ar, ma) in models.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                y = np.asarray(row.values_, float)
                out += [(row.key, k, minus_two_log(y - y.mean(), *coefficients)) for k, coefficients in named.items()]
            yield pd.DataFrame(out, columns=[KEY, "model", "minus_two_log"])

    return _spread(history, ()).mapInPandas(run, f"{KEY} string, model string, minus_two_log double")


def _choose(
    history: DataFrame, orders: Sequence[Order], order_from: str | None, exog: Sequence[str] = ()
) -> DataFrame:
    """(key, p, d, q, aic): per series the order with the least AIC, ties to the smallest order.

    With ``order_from`` only that series (``"first"``: the one with the smallest key) is searched,
    and the others are fitted once, with the order found for it. Where no candidate fits it, there
    is no order to share, and every series is searched on its own.
    """
    best = F.min_by(F.struct("p", "d", "q", "aic"), F.struct("aic", "p", "d", "q")).alias("b")

    def own() -> DataFrame:
        return fit(history, orders, exog).groupBy(KEY).agg(best).select(KEY, "b.*")

    if order_from is None:
        return own()
    lead = order_from
    if order_from == "first":
        lead = history.agg(F.min(F.col(KEY).cast("string"))).first()[0]
    found = fit(history.filter(F.col(KEY).cast("string") == F.lit(lead)), orders, exog).agg(best).select("b.*").first()
    if found is None or found.aic is None or not np.isfinite(found.aic):
        return own()
    return fit(history, [(found.p, found.d, found.q)], exog, among=orders).select(KEY, "p", "d", "q", "aic")


def best_orders(
    history: DataFrame, orders: Sequence[Order] | None = None, order_from: str | None = None
) -> DataFrame:
    """(series_key, p, d, q, target) with target = -AIC."""
    chosen = _choose(history, orders or candidates(), order_from)
    return chosen.select(KEY, "p", "d", "q", (-F.col("aic")).alias("target"))


def forecast(
    history: DataFrame,
    horizon: int = 30,
    orders: Sequence[Order] | None = None,
    order_from: str | None = None,
    freq: str = "D",
    exog: Sequence[str] = (),
    future: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """(series_key, time_period, yhat, p, d, q): ``horizon`` buckets after each last observation.

    Orders are scored first; only the chosen one of each series is forecast. With regressors
    (``exog``) their values over the horizon are needed: ``future`` has (series_key, time_period,
    the regressors). A series that no candidate fits, or whose future regressors are missing, keeps
    its rows with a null ``yhat``. With ``exact`` the chosen order's coefficients maximise the exact likelihood.
    """
    if bool(exog) != (future is not None):
        raise ValueError("exog and future go together")
    orders, exog = list(orders or candidates()), list(exog)
    n = len(exog)
    rows = _spread(history, exog).join(_choose(history, orders, order_from, exog), F.col("key") == F.col(KEY)).drop(KEY)
    if n:
        points = F.array_sort(F.collect_list(F.struct(PERIOD, *exog))).alias("f")
        later = future.na.drop(subset=[PERIOD, *exog]).groupBy(F.col(KEY).cast("string").alias("k")).agg(points)
        rows = rows.join(later, F.col("key") == F.col("k"), "left").drop("k")
        ahead_only = F.filter("f", lambda p: p[PERIOD] > F.col("last_time"))
        rows = rows.withColumn("f", ahead_only)
        rows = rows.withColumns({f"f{i}": F.col("f")[c] for i, c in enumerate(exog)}).drop("f")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                order, ahead = (row.p, row.d, row.q), None
                reach = max(reach_for(len(row.values_), orders), row.p, row.q)
                model = fit_one(np.asarray(row.values_, dtype=float), order, reach, _regressors(row, n))
                if exact and model is not None:
                    model |= maximise(model)
                known = not n or (row.f0 is not None and len(row.f0) >= horizon)
                if model is not None and known:
                    made = forecast_one(model, row.d, horizon)
                    if n:
                        made = made + _regressors(row, n, "f")[:horizon] @ model["exog"]
                    ahead = made if np.all(np.isfinite(made)) else None
                out.append((row.key, *order, ahead, row.last_time))
            yield pd.DataFrame(out, columns=_AHEAD.names)

    chosen = rows.mapInPandas(run, _AHEAD)
    ahead = F.coalesce("ahead", F.array_repeat(F.lit(None).cast("double"), horizon))
    dated = chosen.select(
        KEY, "p", "d", "q",
        F.explode(
            F.arrays_zip(future_periods(F.col("last_time"), horizon, freq).alias("t"), ahead.alias("y"))
        ).alias("f"),
    )
    return dated.select(KEY, F.col("f.t").alias(PERIOD), F.col("f.y").alias("yhat"), "p", "d", "q")
