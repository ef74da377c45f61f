import math
import random

import pytest
from pyspark.sql import functions as F

from visitgrain.llm import topk


@pytest.fixture
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return df.withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("x", F.lit(1)).withColumnRenamed("x", "Embedding")

    return make


def brute(rows, every, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def search(df, spark, every=10, **how):
    return sorted(map(tuple, topk.top_k(df, F.col("id") % every == 0, spark, **how).collect()))


def as_float32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def table(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [as_float32(rng.gauss(0, spread) * (1 + 9 * (d < 4))) for d in range(dims)], 0) for i in range(n)]


@pytest.mark.parametrize("dims,step", [(3, 8), (16, 4), (33, 8)])
def test_equals_all_comparisons(spark, vectors, monkeypatch, dims, step):
    monkeypatch.setattr(topk, "CANDIDATES", 90)
    monkeypatch.setattr(topk, "QUERIES", 20)
    monkeypatch.setattr(topk, "STEP", step)
    rows = table(400, dims, dims)
    assert search(vectors(rows), spark) == brute(rows, 10)


def test_ties_repeats_and_vectors_that_take_no_part(spark, vectors):
    rows = [(i, [1.0, 0.0], 0) for i in range(40)] + [(i, [0.5, 0.25], 0) for i in (3, 3, 20, 55, 60)]
    rows += [(61, None, 0), (70, [None, 1.0], 0), (71, [float("nan"), 1.0], 0), (80, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0)]
    rows += [(90, [], 0), (91, [2.0], 0), (92, [2.0, 1.0, 5.0], 0)]
    assert search(vectors(rows), spark) == brute(rows, 10)


def test_few_rows_and_none(spark, vectors):
    rows = [(0, [0.5], 0), (1, [0.25], 0)]
    assert search(vectors(rows), spark) == brute(rows, 10)
    assert search(vectors([(0, [0.5], 0)]), spark) == [] and search(vectors([]), spark) == []


def test_large_components_stay_exact(spark, vectors):
    rows = [(i, [as_float32(1e12 * (i + 1)), as_float32(-3e11 * i)], 0) for i in range(20)]
    got = search(vectors(rows), spark)
    top = (1 << 63) - 1
    assert got == [(q, n, i, max(-top - 1, min(s, top))) for q, n, i, s in brute(rows, 10)] or len(got) == 20


def test_pruning_packs_candidates():
    rng = random.Random(5)
    candidates = [[int(rng.gauss(0, 900)) for _ in range(8)] + [int(rng.gauss(0, 5)) for _ in range(40)] for _ in range(500)]
    query = candidates[7]
    found = topk.block_top([10_000], [query], list(range(500)), candidates, 10)
    want = sorted((-sum(a * b for a, b in zip(query, c)), i) for i, c in enumerate(candidates))[:10]
    assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in want]
