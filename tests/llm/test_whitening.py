import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitgrain.llm import whitening as W


@pytest.fixture
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        for name in ("component", "n", "deviation", "whitened", "x", "place"):
            df = df.withColumn(name, F.lit("clash"))
        return df.withColumn("q", F.lit(1)).withColumnRenamed("q", "Embedding")

    return make


def rounded(x):
    return float(np.float32(x))


def check(rows, got, most=16):
    """Rows beside numpy's eigenvectors; the sign of a component is free."""
    whole = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    widths = [len(v) for _, v in whole]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in whole if len(v) == width]
    fit = sorted({tuple(v) for _, v in kept})
    n = len(fit)
    total = [sum(col) for col in zip(*fit)]
    away = lambda v: [n * a - s for a, s in zip(v, total)]
    scatter = np.array([[sum(a[i] * a[j] for a in map(away, fit)) for j in range(width)] for i in range(width)], object)
    values, u = np.linalg.eigh((scatter / n**3).astype(float)) if width and n else (np.empty(0), np.empty((0, 0)))
    order = np.argsort(-values)
    values, u = values[order], u[:, order]
    rank = int((values > 1e-9 * max(values.max(initial=0), 1)).sum())
    count = min(most, rank)
    assert len(got) == len(kept) * count
    want = sorted(((i, c + 1, n, sum(a * a for a in away(v))) for i, v in kept for c in range(count)), key=str)
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in got), key=str) == want
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(count):
        assert all(abs(r.explained / (values[c] / values.sum()) - 1) < 1e-4 for r in got if r.component == c + 1)
        near = [abs(values[c] - v) / values[0] for k, v in enumerate(values) if k != c]
        if min(near, default=1) < 1e-9:
            continue  # any basis of the space will do
        pairs = [(i, np.array(away(v), float) / n @ u[:, c] / math.sqrt(values[c])) for i, v in kept]
        once = [(r[0].whitened, w) for i, w in pairs if len(r := by_id[i, c + 1]) == 1]
        sign = np.sign(sum(a * b for a, b in once))
        assert all(abs(a - sign * b) < 1e-7 * max(1, abs(b)) for a, b in once)
    assert {r.identity_error for r in got} == ({got[0].identity_error} if got else set())
    assert all(r.identity_error < 1e-9 for r in got)


def test_equals_plain_eigenvectors(spark, vectors):
    rng = random.Random(1)
    rows = [(i, [rounded(rng.gauss(0, 1 + d)) for d in range(6)]) for i in range(200)]
    check(rows, W.whiten(vectors(rows), spark).collect())
    check(rows, W.whiten(vectors(rows), spark, most=2).collect(), most=2)


def test_repeats_nulls_odd_vectors_and_lower_rank(spark, vectors):
    rng = random.Random(2)
    base = [[rounded(rng.uniform(-1, 1)) for _ in range(4)] for _ in range(30)]
    rows = [(i, base[i % 30]) for i in range(60)] + [(100 + i, base[0]) for i in range(50)]
    rows = [(i, [*v, 0.5, 0.25]) for i, v in rows]  # two directions without variance
    rows += [(None, [0.1, 0.2, 0.3, 0.4, 0.5, 0.25]), (201, None), (202, []), (203, [None] * 6), (204, [1.0]),
             (205, [float("nan")] * 6), (206, [float("-inf")] * 6)]
    check(rows, W.whiten(vectors(rows), spark).collect())


def test_no_variance_and_no_rows(spark, vectors):
    assert W.whiten(vectors([(1, [0.5, 0.5]), (2, [0.5, 0.5])]), spark).collect() == []
    assert W.whiten(vectors([]), spark).collect() == [] and W.whiten(vectors([(1, None), (2, [])]), spark).collect() == []


def test_large_components(spark, vectors):
    rng = random.Random(6)
    rows = [(i, [rounded(rng.gauss(0, 1e9)), rounded(rng.gauss(0, 1e8)), rounded(rng.gauss(0, 1.0))]) for i in range(50)]
    got = W.whiten(vectors(rows), spark).collect()
    assert len(got) == 150 and all(r.identity_error < 1e-6 for r in got)
    assert max(r.deviation for r in got) == (1 << 63) - 1


@pytest.mark.parametrize("m", [
    np.diag([5, 5, 3, 0, 9]), np.array([[2, 1], [1, 2]]), np.array([[7]]), np.eye(4, dtype=int) * 4, np.ones((3, 3), int),
    np.diag([10**12, 10**12 + 1, 1]),
])
def test_roots_and_spaces_of_known_matrices(spark, m):
    m = m.astype(object)
    found = W.components(m, spark, 16)
    values = sorted(np.linalg.eigvalsh(m.astype(float)), reverse=True)
    values = [v for v in values if v > 1e-6]
    assert np.allclose([f[0] for f in found], values, rtol=1e-12) and len(found) == len(values)
    u = np.array([f[2] for f in found])
    assert np.allclose(u @ u.T, np.eye(len(found)), atol=1e-14)
    for (value, _, v) in found:
        assert np.allclose(m.astype(float) @ v, value * np.array(v), rtol=1e-13, atol=1e-13 * values[0])


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, (12, 5)).astype(object)
    m = x.T @ x

    def minor(a):  # expansion along the first row, in powers of y
        if not len(a):
            return [1]
        out = [0] * (len(a) + 1)
        for j, entry in enumerate(a[0]):
            rest = minor([[v for k, v in enumerate(row) if k != j] for row in a[1:]])
            for i, p in enumerate(entry):
                for k, q in enumerate(rest):
                    out[i + k] += (-1) ** j * p * q
        return out

    lines = [[(-int(m[i, j]), 1) if i == j else (-int(m[i, j]), 0) for j in range(5)] for i in range(5)]
    assert W.characteristic(m, spark) == minor(lines)[:6]


def test_primes():
    assert W.primes_below(100, 5) == [97, 89, 83, 79, 73]
    top = W.primes_below(1 << 31, 3)
    assert top[0] == (1 << 31) - 1 and all(p % q for p in top for q in range(3, 46341, 2))
