"""Exact Gaussian likelihood of ARMA models by a Kalman filter in state-space form.

The state is Harvey's: r = max(p, q + 1) elements, the first of which is the centred series. It starts in the
stationary distribution, whose covariance solves P = T P T' + R R'. The variance is concentrated
out. Once the filter's covariance no longer changes, its gain is kept.

``maximise`` climbs from the two-step estimate over numbers without bounds: hyperbolic tangents of
these are partial autocorrelations, and the Durbin-Levinson recursion makes stationary AR (and invertible MA)
coefficients of them, so no step can leave the admissible region.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_STEADY = 1e-12
#: Partial autocorrelations are held this far from one.
_EDGE = 1e-6


def from_partial(partial: np.ndarray) -> np.ndarray:
    """AR coefficients of partial autocorrelations."""
    out = np.empty(0)
    for r in partial:
        out = np.r_[out - r * out[::-1], r]
    return out


def to_partial(ar: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of stationary AR coefficients."""
    out, left = [], np.asarray(ar, float)
    while len(left):
        r = float(np.clip(left[-1], -1 + _EDGE, 1 - _EDGE))
        out.append(r)
        head = left[:-1]
        left = (head + r * head[::-1]) / (1 - r * r)
    return np.array(out[::-1])


def _stationary_covariance(t: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """P = t P t' + noise by doubling."""
    p, a = noise.copy(), t.copy()
    for _ in range(60):
        more = a @ p @ a.T
        p = p + more
        if np.abs(more).max() <= 1e-15 * np.abs(p).max():
            break
        a = a @ a
    return p


def filtered(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(sum of squares of standardised errors, sum of logs of their scales, one-step errors) of a centred series."""
    p, q = len(ar), len(ma)
    r = max(p, q + 1)
    t = np.zeros((r, r))
    t[:p, 0] = ar
    t[: r - 1, 1:] = np.eye(r - 1)
    load = np.r_[1.0, ma, np.zeros(r - 1 - q)]
    noise = np.outer(load, load)
    cov, state = _stationary_covariance(t, noise), np.zeros(r)
    squares = logs = 0.0
    errors = np.empty(len(x))
    steady, gain, scale = False, np.zeros(r), 1.0
    for i, value in enumerate(x):
        if not steady:
            scale = cov[0, 0]
            gain = t @ cov[:, 0] / scale
            after = t @ cov @ t.T + noise - np.outer(gain, gain) * scale
            steady = bool(np.abs(after - cov).max() < _STEADY * scale)
            cov = after
        error = value - state[0]
        state = t @ state + gain * error
        squares += error * error / scale
        logs += np.log(scale)
        errors[i] = error
    return float(squares), float(logs), errors


def minus_two_log(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> float:
    """Minus twice the log-likelihood of a centred series, its variance at the best value."""
    n = len(x)
    squares, logs, _ = filtered(x, ar, ma)
    return n * float(np.log(2 * np.pi * max(squares / n, np.finfo(float).tiny)) + 1) + logs


def climb(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 60, step: float = 1e-5) -> tuple[np.ndarray, float]:
    """Least value of f by BFGS with central differences; never worse than the start."""
    x, value = start.copy(), f(start)

    def slope(at: np.ndarray) -> np.ndarray:
        return np.array([(f(at + e) - f(at - e)) / (2 * step) for e in np.eye(len(at)) * step])

    g, inverse = slope(x), np.eye(len(x))
    for _ in range(rounds):
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(len(x)), -g
        length, most = 1.0, np.abs(way).max(initial=0)
        if most > 1:
            length = 1 / most
        while length > 1e-8:
            new = x + length * way
            got = f(new)
            if np.isfinite(got) and got <= value + 1e-4 * length * (way @ g):
                break
            length /= 2
        else:
            break
        g_new = slope(new)
        moved, turned = new - x, g_new - g
        along = moved @ turned
        if along > 1e-12:
            left = np.eye(len(x)) - np.outer(moved, turned) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
        done = value - got < 1e-9 * max(1.0, abs(value)) and np.abs(g_new).max(initial=0) < 1e-3
        x, value, g = new, got, g_new
        if done:
            break
    return x, value


def maximise(model: dict) -> dict:
    """``aic``, ``intercept``, ``ar`` and ``ma`` at the greatest exact likelihood, from a two-step estimate.

    The AIC counts the coefficients, the mean where the series isn't differenced, the regressors and the variance.
    """
    w, p, q = model["w"], len(model["ar"]), len(model["ma"])
    differenced = len(w) < len(model["y"])
    spread = float(np.std(w)) or 1.0
    level = 0.0 if differenced else float(np.mean(w))

    def parts(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = 0.0 if differenced else level + spread * u[p + q]
        bound = np.tanh(u[: p + q]) * (1 - _EDGE)
        return mean, from_partial(bound[:p]), -from_partial(bound[p:])

    def score(u: np.ndarray) -> float:
        mean, ar, ma = parts(u)
        return minus_two_log(w - mean, ar, ma)

    inside = lambda c: np.arctanh(np.clip(to_partial(c), -0.995, 0.995))
    start = np.r_[inside(model["ar"]), inside(-model["ma"]), [] if differenced else 0.0]
    best, value = climb(score, start) if len(start) else (start, score(start))
    mean, ar, ma = parts(best)
    count = p + q + (not differenced) + len(model["exog"]) + 1
    return {"aic": value + 2 * count, "intercept": mean * float(1 - ar.sum()), "ar": ar, "ma": ma}
