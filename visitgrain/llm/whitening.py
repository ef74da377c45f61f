"""Whitening of embeddings; eigenvalues from an exact characteristic polynomial.

1. Components become whole numbers x; the fit list is the distinct x-vectors. Tasks add sums, and
   then products of x less a common whole vector near the mean, exactly. From those comes the integer
   scatter M = n * sum((x - c)(x - c)') - t t', which is n**2 times the covariance, without rounding.
2. The characteristic polynomial of M: for each of many primes below 2**31 the matrix is reduced to
   Hessenberg form modulo the prime and its polynomial read off (tasks share the primes); Chinese
   remaindering joins the coefficients, whose size is bounded by the trace.
3. All roots are real, so the number of roots beyond a point is exactly the number of sign changes
   of the polynomial shifted there. Bisection by that count isolates the greatest roots; bracketed
   Newton steps in whole numbers narrow each to 2**-PRECISION of the trace.
4. Each component is the null space of M - root, by inverse iteration in whole-number fixed point (tasks
   share the roots). Roots that can't be told apart at this precision form one space, whose basis
   is made orthogonal.
5. Rows are projected in doubles; the covariance of what comes out is measured over the fit list.

Only the scatter (width**2 numbers), polynomial and components reach the driver; their size is set
by the number of dimensions, not of rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
vectors whose number of components isn't the most frequent one (ties: the greater). Repeated rows
each get their answer, and count once in the fit. Directions without any variance are no components, so there
are fewer than ``most`` components where the rank is lower, and none, hence no rows, for one
distinct vector or an empty table. x is held to about +-2**62, and ``deviation`` to the range of a long. Null ids
stay null; other columns are ignored. A component's sign makes its first largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.llm.common import pick, scan, settle, type_of
from visitgrain.llm.vectors import ROWS, as_longs, exact, matrix, sound, totals, whole

SCALE = 64
OFFSET = 1_000_000
MOST_COMPONENTS = 16
#: Roots are found to this many bits below the trace.
PRECISION = 192
#: Primes reduced together in a task.
TOGETHER = 8


def frequent_width(rows: DataFrame, vector_col: str) -> int:
    """The most frequent number of components; 0 without rows."""
    counted = rows.where(sound(vector_col)).groupBy(F.size(vector_col).alias("width")).count()
    best = counted.orderBy(F.desc("count"), F.desc("width")).first()
    return 0 if best is None else best.width


# --- the integer scatter ---


def _listed(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension."""

    def add(columns, found) -> None:
        x = _listed(columns[0], width)
        found[width] = found.get(width, 0) + len(x)
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        for d in range(width):
            found[d] = found.get(d, 0) + (int(high[d]) << 32) + int(low[d])

    found = totals(fit.select("x"), add)
    return found.get(width, 0), [found.get(d, 0) for d in range(width)]


def scatter(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """n * sum(x x') - S S' as Python's integers, centred before multiplying."""
    width = len(total)
    centre = np.array([s // n for s in total], np.int64)
    upper = np.triu_indices(width)

    def add(columns, found) -> None:
        away = _listed(columns[0], width) - centre
        most = int(np.abs(away).max(initial=0))
        if most * most * max(len(away), 1) < 1 << 53:  # exact in doubles
            wide = away.astype(np.float64)
            made = (wide.T @ wide).astype(np.int64)
        else:
            wide = away.astype(object)
            made = wide.T @ wide
        for place, value in enumerate(made[upper].tolist()):
            found[place] = found.get(place, 0) + value

    found = totals(fit.select("x"), add)
    products = np.zeros((width, width), object)
    for place, (i, j) in enumerate(zip(*upper)):
        products[i, j] = products[j, i] = found.get(place, 0)
    rest = np.array([s - n * int(c) for s, c in zip(total, centre)], object)
    return n * products - np.outer(rest, rest)


# --- the characteristic polynomial ---


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest odd primes below ``top`` (at most 2**32), greatest first."""

    def is_prime(m: int) -> bool:
        if any(m % q == 0 for q in (3, 5, 7, 11, 13)):
            return False
        odd, twos = m - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough for every number below 3,215,031,751
            y = pow(base, odd, m)
            if y in (1, m - 1):
                continue
            for _ in range(twos - 1):
                y = y * y % m
                if y == m - 1:
                    break
            else:
                return False
        return True

    found, m = [], top - 1 - top % 2
    while len(found) < count:
        if is_prime(m):
            found.append(m)
        m -= 2
    return found


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, exponent = np.ones_like(base), exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1, out * base % p, out)
        base, exponent = base * base % p, exponent >> 1
    return out


def polynomials(m: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients, of the lowest power first, of det(y - m) modulo each prime; a row per prime."""
    width = len(m)
    p = np.array(primes, np.int64)
    one, two, three = p, p[:, None], p[:, None, None]
    a = np.stack([(m % q).astype(np.int64) for q in primes])
    each = np.arange(len(primes))
    for k in range(width - 2):
        pivot = (a[:, k + 1 :, k] != 0).argmax(axis=1) + k + 1
        rows = a[each, pivot].copy()
        a[each, pivot], a[:, k + 1] = a[:, k + 1].copy(), rows
        columns = a[each, :, pivot].copy()
        a[each, :, pivot], a[:, :, k + 1] = a[:, :, k + 1].copy(), columns
        inverse = _power(a[:, k + 1, k], one - 2, one)
        times = a[:, k + 2 :, k] * inverse[:, None] % two
        a[:, k + 2 :] = (a[:, k + 2 :] - times[:, :, None] * a[:, k + 1, None] % three) % three
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * times[:, None, :] % three).sum(axis=2)) % two
    made = np.zeros((len(primes), width + 1, width + 1), np.int64)
    made[:, 0, 0] = 1
    for k in range(1, width + 1):
        now = np.zeros((len(primes), width + 1), np.int64)
        now[:, 1:] = made[:, k - 1, :-1]
        now = (now - a[:, k - 1, k - 1, None] * made[:, k - 1] % two) % two
        below = np.ones(len(primes), np.int64)
        for i in range(1, k):
            below = below * a[:, k - i, k - i - 1] % one
            now = (now - (a[:, k - i - 1, k - 1] * below % one)[:, None] * made[:, k - i - 1] % two) % two
        made[:, k] = now
    return made[:, width]


def characteristic(m: np.ndarray, spark: SparkSession) -> list[int]:
    """The coefficients of det(y - m), lowest power first, of a symmetric m without negative roots."""
    width, trace = len(m), int(np.trace(m))
    bound = max(comb(width, k) * trace**k // width**k for k in range(width + 1)) + 1
    count = (2 * bound).bit_length() // 30 + 1
    primes = primes_below(1 << 31, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_pylist()
            for g in groups:
                mine = primes[g * TOGETHER : (g + 1) * TOGETHER]
                made = [row.tolist() for row in polynomials(m, mine)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["p", "c"]
                )

    groups = -(-count // TOGETHER)
    tasks = min(groups, max(2, spark.sparkContext.defaultParallelism))
    found = spark.range(0, groups, 1, tasks).mapInArrow(run, "p bigint, c array<bigint>").collect()
    product = 1
    for r in found:
        product *= r.p
    out = [0] * (width + 1)
    for r in found:
        others = product // r.p
        weight = others * pow(others % r.p, -1, r.p)
        for i, c in enumerate(r.c):
            out[i] += c * weight
    out = [c % product for c in out]
    return [c - product if 2 * c > product else c for c in out]


# --- its roots ---


def _beyond(scaled: list[int], at: int) -> int:
    """How many roots of a real-rooted polynomial are greater than ``at``, counted as often as they repeat."""
    c = scaled[::-1]
    n = len(c)
    shifted = []
    for k in range(n):  # Taylor's shift by repeated synthetic division
        for i in range(1, n - k):
            c[i] += at * c[i - 1]
        shifted.append(c[n - 1 - k])
    signs = [v > 0 for v in shifted if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _narrow(scaled: list[int], low: int, high: int) -> int:
    """The end ``high`` of the unit interval (high - 1, high] that holds the one root of (low, high]."""

    def value(at: int) -> tuple[int, int]:
        v = dv = 0
        for c in reversed(scaled):
            dv = dv * at + v
            v = v * at + c
        return v, dv

    v_high, slope = value(high)
    if v_high == 0:
        return high
    guess = high - v_high // slope if slope else (low + high) // 2
    turn = False
    while high - low > 1:
        at = guess if low < guess < high and not turn else (low + high) // 2
        width = high - low
        v, slope = value(at)
        if v == 0:
            return at
        if (v > 0) == (v_high > 0):
            high, guess = at, min(at - v // slope, at - 1) if slope else at - 1
        else:
            low, guess = at, max(at - v // slope, at + 1) if slope else at + 1
        turn = not turn and 2 * (high - low) > width
    return high


def greatest_roots(coefficients: list[int], most: int, bits: int) -> list[tuple[int, int]]:
    """(root times 2**bits, multiplicity) of the greatest positive roots, falling, at least ``most``
    of them if there are, counting multiplicity. All roots must be real and none negative.

    The coefficients belong to a monic polynomial. Roots closer than 2**-bits count as one.
    """
    degree = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    scaled = [c << (bits * (degree - i)) for i, c in enumerate(coefficients)][zeros:]
    most = min(most, degree - zeros)
    if not most:
        return []
    top = (-coefficients[degree - 1] + 1) << bits  # the sum of all roots, and one more
    found, work = [], [(0, top, degree - zeros, 0)]
    while work:
        low, high, above_low, above_high = work.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1:
            found.append((_narrow(scaled, low, high), 1))
        elif high - low == 1:
            found.append((high, above_low - above_high))
        else:
            middle = (low + high) // 2
            above = _beyond(scaled, middle)
            work += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return sorted(found, reverse=True)


# --- its components ---


def null_space(m: list[list[int]], root: int, bits: int, count: int, rounds: int = 3) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of m - root / 2**bits, by inverse iteration.

    Numbers are integers over 2**point; a pivot of zero, at an exact root, is one unit instead.
    """
    width, point = len(m), 2 * bits + 64
    a = np.array([[v << point for v in row] for row in m], object).reshape(width, width)
    for i in range(width):
        a[i, i] -= root << (point - bits)
    order = np.arange(width)
    for k in range(width):
        pivot = k + max(range(width - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, width):
            if a[i, k]:
                a[i, k] = (a[i, k] << point) // a[k, k]
                a[i, k + 1 :] -= (a[i, k] * a[k, k + 1 :]) >> point

    def solve(b: np.ndarray) -> np.ndarray:
        b = b[order].copy()
        for i in range(width):
            b[i] -= int(a[i, :i] @ b[:i]) >> point if i else 0
        for i in range(width - 1, -1, -1):
            rest = int(a[i, i + 1 :] @ b[i + 1 :]) if i + 1 < width else 0
            b[i] = ((b[i] << point) - rest) // a[i, i]
        return b

    def unit(b: np.ndarray) -> np.ndarray:
        shrink = max(max(abs(v) for v in b).bit_length() - point - 8, 0)
        b = b >> shrink if shrink else b
        length = isqrt(int(b @ b)) or 1
        return (b << point) // length

    state = 20240229
    vectors = []
    for _ in range(count):
        start = []
        for _ in range(width):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            start.append(((state >> 33) - (1 << 30)) << (point - 31))
        vectors.append(unit(np.array(start, object)))
    for _ in range(rounds):
        made = []
        for b in vectors:
            b = unit(solve(b))
            for other in made:
                b = b - ((other * (int(b @ other) >> point)) >> point)
            made.append(unit(b))
        vectors = made
    out = []
    for b in vectors:
        largest = max(range(width), key=lambda i: (abs(b[i]), -i))
        sign = -1 if b[largest] < 0 else 1
        out.append([sign * int(v) / (1 << point) for v in b])
    return out


def components(m: np.ndarray, spark: SparkSession, most: int) -> list[tuple[float, float, list[float]]]:
    """(eigenvalue, share of the trace, unit vector), eigenvalues falling, of a scatter m."""
    width, trace = len(m), int(np.trace(m)) if len(m) else 0
    if not trace:
        return []
    bits = max(PRECISION - trace.bit_length(), 0)
    roots = greatest_roots(characteristic(m, spark), most, bits)
    rows = [[int(v) for v in row] for row in m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                made = null_space(rows, roots[r][0], bits, roots[r][1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * len(made), pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["r", "v"]
                )

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "r bigint, v array<double>").collect()
    out = []
    for r, (root, _) in enumerate(roots):
        value, share = root / (1 << bits), root / (trace << bits)
        out += [(value, share, list(x.v)) for x in found if x.r == r]
    return out[:most]


# --- whitening ---


def _measure(fit: DataFrame, project, count: int) -> float:
    """Largest entry, without sign, of the whitened fit list's covariance less the identity."""

    def summed(make) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = make(project(batch.column(0).slice(low, ROWS)))
                    total = part if total is None else total + part
            if total is not None:
                places = pa.array(range(len(total)), pa.int32())
                yield pa.RecordBatch.from_arrays([places, pa.array(total.tolist(), pa.float64())], names=["place", "s"])

        made = fit.select("x").mapInArrow(run, "place int, s double").groupBy("place").agg(F.sum("s").alias("s"))
        return [r.s for r in made.orderBy("place").collect()]

    *first, n = summed(lambda w: np.append(w.sum(axis=0), len(w)))
    mean = np.array(first) / n

    def products(w: np.ndarray) -> np.ndarray:
        w = w - mean
        return (w.T @ w).ravel()

    covariance = np.array(summed(products)).reshape(count, count) / n
    return float(np.abs(covariance - np.eye(count)).max())


def whiten(
    rows: DataFrame,
    spark: SparkSession,
    most: int = MOST_COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row for each vector and component: the id, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``."""
    rows = pick(rows, id_col, vector_col)
    width = frequent_width(rows, vector_col)
    taken = rows.where(sound(vector_col) & (F.size(vector_col) == width))
    fit = settle(taken.select(whole(vector_col, scale, offset).alias("x")).distinct(), spark, "fit")
    n, total = sums(fit, width) if width else (0, [])
    found = components(scatter(fit, n, total), spark, most) if n else []
    count = len(found)
    into = np.array([v for _, _, v in found]).reshape(count, width).T / np.array([sqrt(e) for e, _, _ in found])
    centre = np.array([s // n for s in total] if n else [], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(total, centre)], object)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        room = n * (int(np.abs(x - centre).max(initial=0)) + 1)
        if room * room * max(width, 1) < 1 << 62:
            return (x - centre) * n - rest.astype(np.int64)
        return (x - centre).astype(object) * n - rest

    def project(column: pa.Array) -> np.ndarray:
        return deviations(_listed(column, width)).astype(np.float64) @ into

    error = _measure(fit, project, count) if count else 0.0
    shares = [share for _, share, _ in found]

    def start():
        def work(ids, vectors):
            places, x = matrix(vectors, width, scale) if count else (np.empty(0, np.int64), np.empty((0, width), np.int64))
            away = deviations(x + offset)
            squares = as_longs((away * away).sum(axis=1))
            each = pa.array(np.repeat(np.arange(len(x)), count))
            made = (away.astype(np.float64) @ into).ravel()
            return {
                id_col: ids.take(pa.array(places)).take(each),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), pa.int32()),
                "deviation": squares.take(each),
                "whitened": pa.array(made, pa.float64()),
                "explained": pa.array(np.tile(np.array(shares, np.float64), len(x)), pa.float64()),
            }

        return work

    out = {id_col: type_of(rows, id_col), "component": "int", "deviation": "bigint", "whitened": "double", "explained": "double"}
    made = scan(rows, [id_col, vector_col], start, out, rows=ROWS)
    return made.select(
        id_col,
        "component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
