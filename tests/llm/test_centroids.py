import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitgrain.llm import centroids
from visitgrain.llm.vectors import MOST


@pytest.fixture
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        for name in ("cluster", "distance", "inertia", "mark", "v", "place"):
            df = df.withColumn(name, F.lit("clash"))
        return df.withColumn("x", F.lit(1)).withColumnRenamed("x", "Embedding")

    return make


def brute(rows, k, rounds, width, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [v for i, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        named = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, named) if a == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    named = assign()
    apart = [far(v, centres[c]) for (_, v), c in zip(kept, named)]
    inertia = [sum(d for d, a in zip(apart, named) if a == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), c, d in zip(kept, named, apart)), key=str)


def run(df, **how):
    made, _ = centroids.clusters(df, **how)
    return sorted(map(tuple, made.collect()), key=str)


def rounded(x):
    return float(np.float32(x))


def test_equals_brute_force(vectors):
    rng = random.Random(3)
    rows = [(i, [rounded(rng.gauss(i % 3, 1)) for _ in range(8)]) for i in range(300)]
    assert run(vectors(rows), k=7, width=8) == brute(rows, 7, 3, 8)


def test_ties_repeats_nulls_and_vectors_that_take_no_part(vectors):
    rng = random.Random(4)
    rows = [(i % 60, [float(rng.randint(-1, 1)), float(rng.randint(-1, 1))]) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0]) for i in range(80)]
    rows += [(None, [0.5, 0.5]), (301, None), (302, []), (303, [1.0]), (304, [None, 1.0]), (305, [float("nan"), 0.0]),
             (306, [float("inf"), 0.0]), (307, [1.0, 2.0, 3.0])]
    for k in (1, 5, 16):
        assert run(vectors(rows), k=k, width=2) == brute(rows, k, 3, 2)


def test_few_rows_and_none(vectors):
    rows = [(1, [0.5, 0.25]), (2, [0.25, 0.5]), (None, [9.0, 9.0])]
    assert run(vectors(rows), width=2) == brute(rows, 16, 3, 2)
    assert run(vectors([]), width=2) == [] and run(vectors([(1, None)]), width=2) == []


def test_large_components_stay_exact(vectors):
    rng = random.Random(5)
    rows = [(i, [rounded(rng.gauss(0, 1e12)), rounded(rng.gauss(0, 1e4))]) for i in range(40)]
    want = [r[:2] + tuple(min(x, (1 << 63) - 1) for x in r[2:5]) + r[5:] for r in brute(rows, 4, 3, 2)]
    assert run(vectors(rows), k=4, width=2) == want


@pytest.mark.parametrize("spread", [1, 50, 1 << 31])
def test_threshold_algorithm_stops_with_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for width in (1, 3, 20):
        x, c = rng.integers(-spread, spread + 1, (200, width)), rng.integers(-spread, spread + 1, (9, width))
        number, far = centroids.nearest(x, c)
        every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert number.tolist() == [e.index(min(e)) for e in every] and [int(f) for f in far] == [min(e) for e in every]


def test_walk_leaves_far_centroids_unmet():
    c = np.array([[0, 0], [1000, 1000], [2000, 2000], [3000, 3000]])
    met = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, (int, np.integer)):
                met.append(int(key))
            return super().__getitem__(key)

    real = centroids.exact
    try:
        centroids.exact = lambda x, room: real(x, room).view(Watched)
        assert centroids.nearest(np.array([[1, 2]]), c)[0].tolist() == [0]
    finally:
        centroids.exact = real
    assert set(met) == {0}


def test_range_is_held(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    made, centres = centroids.clusters(df, width=2)
    assert sorted(map(max, centres)) == [0, MOST] and made.where("distance = 0").count() == 2
