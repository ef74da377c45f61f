"""Exact top-k inner products by columnar branch and bound.

Candidates are dealt into blocks and held in vertical layout: one row per dimension. Scores grow
one block of dimensions at a time. After each, the rest of a score is at most the product of the
norms of what remains of both vectors (the remaining mass); candidates whose score so far plus that
bound can't reach the query's k-th best lower bound are dropped, and the survivors are packed
together before the next block. Dimensions come in order of the queries' mass, so that little is
left early.

Queries are dealt into blocks too; each block of queries meets each block of candidates in one
task, and the best k of every meeting are merged. Sizes of blocks are fixed, so a task's memory
doesn't grow with the table.

Components x become floor(scale * x), x as double; scores are exact integers, held to the range of
a long. Defined results:
vectors that are null or hold null or non-finite components take no part, nor does a row without
an id; of rows with the query's own id none is a candidate; a repeated candidate row counts each
time; a repeated query id is asked once, with its least vector; vectors of different length are
compared as if the shorter had zeros; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from visitgrain.llm.common import pick, settle

#: Candidates and queries of a block, and dimensions of a step.
CANDIDATES = 4096
QUERIES = 1024
STEP = 8


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): scaled integer vectors of the rows that take part."""
    rows = pick(rows, id_col, vector_col)
    wide = F.transform(vector_col, lambda x: x.cast("double"))
    sound = F.forall(
        vector_col,
        lambda x: x.isNotNull()
        & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).alias("id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v")
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as columns: one row per dimension."""
    out = np.zeros((width, len(vectors)), np.int64)
    for j, v in enumerate(vectors):
        out[: len(v), j] = v
    return out


def block_top(query_ids, queries, ids, candidates, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's best k in a block; ties to smaller ids.

    Whole numbers up to 2**53 are exact as doubles; larger ones are kept as Python's integers.
    """
    width = max((len(v) for v in [*queries, *candidates]), default=0)
    q, c = _matrix(queries, width), _matrix(candidates, width)
    greatest = [max((abs(int(x)) for x in (m.min(initial=0), m.max(initial=0))), default=0) for m in (q, c)]
    kind = np.float64 if greatest[0] * greatest[1] * max(width, 1) < 1 << 53 else object
    q, c = q.astype(kind), c.astype(kind)
    mass = (q.astype(np.float64) ** 2).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    q, c, ids = q[order], c[order], np.asarray(ids, np.int64)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    # Remaining mass after each dimension, with room for rounding.
    rest_q = np.sqrt(np.vstack([np.cumsum((qf**2)[::-1], axis=0)[::-1], np.zeros((1, q.shape[1]))])) * (1 + 1e-9)
    rest_c = np.sqrt(np.vstack([np.cumsum((cf**2)[::-1], axis=0)[::-1], np.zeros((1, c.shape[1]))])) * (1 + 1e-9)
    out = []
    for j, query in enumerate(query_ids):
        live = np.flatnonzero(ids != query)
        score = np.zeros(len(live), c.dtype)
        columns = c
        packed = False
        for low in range(0, width, STEP):
            high = min(low + STEP, width)
            part = columns[low:high] if packed else columns[low:high][:, live]
            score = score + q[low:high, j] @ part
            if high < width and len(live) > 2 * k:
                room = rest_q[high, j] * rest_c[high, live] + 1.0
                so_far = score.astype(np.float64)
                floor = np.partition(so_far - room, len(live) - k)[len(live) - k]
                stay = so_far + room >= floor
                if stay.sum() < 0.7 * len(live):  # pack the survivors
                    live, score = live[stay], score[stay]
                    columns, packed = c[:, live], True
        best = sorted(zip((-score).tolist(), ids[live].tolist()))[:k] if len(live) <= 4 * k else _best(score, ids[live], k)
        out += [(int(query), int(i), max(-(1 << 63), min(int(-s), (1 << 63) - 1))) for s, i in best]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    at_least = np.sort(score)[len(score) - k]
    those = np.flatnonzero(score >= at_least)
    return sorted(zip((-score[those]).tolist(), ids[those].tolist()))[:k]


def top_k(
    rows: DataFrame,
    is_query: Column,
    spark: SparkSession,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``id_col`` and ``score`` of each query's best k.

    ``is_query`` is a condition on column ``id``.
    """
    vectors = integer_vectors(rows, scale, id_col, vector_col)
    counted = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, asked = max(1, ceil(counted[0] / CANDIDATES)), max(1, ceil(counted[1] / QUERIES))
    # Dealt by a hash of the whole row and a random number, so that repeated rows spread.
    deal = lambda n: F.pmod(F.xxhash64("id", "v", F.rand(7)), F.lit(n))
    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    left = settle(queries.withColumn("q", deal(asked)), spark, "queries")
    right = settle(vectors.withColumn("c", deal(blocks)), spark, "candidates")
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("q", F.col("c").cast("long").alias("c"), "id", "v")
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))).select(F.col("q").cast("long").alias("q"), "c", "id", "v")

    def meet(query_rows: pa.Table, candidate_rows: pa.Table) -> pa.Table:
        if query_rows.num_rows and candidate_rows.num_rows:
            found = block_top(
                query_rows["id"].to_pylist(),
                query_rows["v"].to_pylist(),
                candidate_rows["id"].to_pylist(),
                candidate_rows["v"].to_pylist(),
                k,
            )
        else:
            found = []
        a, b, s = zip(*found) if found else ((), (), ())
        return pa.table(
            {"query_id": pa.array(a, pa.int64()), "vec": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())}
        )

    met = (
        left.groupBy("q", "c")
        .cogroup(right.groupBy("q", "c"))
        .applyInArrow(meet, "query_id bigint, vec bigint, score bigint")
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    return (
        met.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec").alias(id_col), "score")
    )
