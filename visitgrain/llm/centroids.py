"""Clustering by centroids; the nearest centroid comes from the threshold algorithm.

For each dimension the centroids stand in a list sorted by their value there. A vector walks every
list outward from its own value, one centroid a step, the nearer side first. A centroid met for the
first time in any list gets its exact distance. What has been met in no list yet is, in each
dimension, at least as far as the list's next entry, so the sum of the squared next distances (the
frontier) is a lower bound for it. The walk stops when the frontier strictly exceeds the best
exact distance; at equality a centroid of a smaller number might still tie.

The centroids (``k`` times ``width`` numbers, a bound set by parameters) go to every task. A round is
one pass over the table: each task adds its vectors to sums by cluster, Spark adds the tasks' sums,
and the driver divides. No vector is shuffled, so a hot vector or source costs what any row costs.
The centroids a round starts from are numbers in the plan; a lost task is run again from its file.

Components x become floor(scale * x), x as double, held to +-2**62; all sums are exact. Defined
results: vectors that are null, hold null or non-finite components, or have not ``width`` components
take no part; a row without an id takes part but comes last as a first centroid; repeated rows are
rows of their own, and of equal hashes the lesser vector comes first; fewer than ``k`` vectors make
fewer centroids; an empty cluster keeps its centroid; distances beyond a long are held to it; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.llm.common import pick, scan, type_of
from visitgrain.llm.vectors import MOST, ROWS, as_longs, exact, matrix, sound, totals, whole

K = 16
WIDTH = 64
SCALE = 64
ROUNDS = 3


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties to the smaller number."""
    n, width = x.shape
    k = len(centroids)
    both = exact(np.concatenate([x, centroids]), 4 * max(width, 1))
    x, centroids = both[:n], both[n:]
    beyond = 1 << 31 if x.dtype == np.int64 else 1 << 64  # more than any difference
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    number, best = np.full(n, k, np.int64), np.full(n, width * beyond * beyond, object)
    if x.dtype == np.int64:
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
    live = np.arange(n)
    up = np.empty((n, width), np.int64)
    for d in range(width):
        up[:, d] = np.searchsorted(values[:, d], x[:, d])
    down = up - 1
    seen = np.zeros((n, k), bool)
    across = np.arange(width)[None, :]
    for _ in range(k):
        at = x[live]
        above = np.where(up < k, values[np.minimum(up, k - 1), across] - at, beyond)
        below = np.where(down >= 0, at - values[np.maximum(down, 0), across], beyond)
        rise = above < below
        step = np.where(rise, above, below)
        stay = (step * step).sum(axis=1) <= best[live]
        if not stay.any():
            break
        live, up, down, rise, seen = live[stay], up[stay], down[stay], rise[stay], seen[stay]
        met = order[np.where(rise, up, down), across]
        new = np.zeros((len(live), k), bool)
        new[np.arange(len(live))[:, None], met] = True
        new &= ~seen
        seen |= new
        for c in np.flatnonzero(new.any(axis=0)):
            rows = live[new[:, c]]
            apart = x[rows] - centroids[c]
            far = (apart * apart).sum(axis=1)
            nearer = (far < best[rows]) | ((far == best[rows]) & (c < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = far[nearer], c
        up, down = up + rise, down - ~rise
        more = ~seen.all(axis=1)
        live, up, down, seen = live[more], up[more], down[more], seen[more]
        if not len(live):
            break
    return number, best


def first_centroids(rows: DataFrame, k: int, width: int, scale: int, seed: str, id_col: str, vector_col: str) -> list[list[int]]:
    """The vectors of the ``k`` least SHA-256 of ``seed:id``."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    fit = rows.where(sound(vector_col) & (F.size(vector_col) == width))
    chosen = fit.select(mark.alias("mark"), whole(vector_col, scale).alias("v"))
    return [list(r.v) for r in chosen.orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()]


def _sums(rows: DataFrame, centroids: list[list[int]], width: int, scale: int, vector_col: str) -> list[tuple[int, int, list[int]]]:
    """(vectors, total distance, sums by dimension) of each cluster."""
    fixed = np.array(centroids, np.int64).reshape(len(centroids), width)
    stride = width + 2

    def add(columns, sums) -> None:
        _, x = matrix(columns[0], width, scale)
        number, far = nearest(x, fixed)
        small = int(np.abs(x).max(initial=0)) * max(len(x), 1) < MOST
        wide = x if small else x.astype(object)
        for c in np.unique(number):
            mine = number == c
            made = [int(mine.sum()), sum(far[mine].tolist()), *wide[mine].sum(axis=0).tolist()]
            for i, value in enumerate(made):
                place = int(c) * stride + i
                sums[place] = sums.get(place, 0) + int(value)

    found = totals(pick(rows, vector_col), add)
    return [
        (found.get(c * stride, 0), found.get(c * stride + 1, 0), [found.get(c * stride + 2 + d, 0) for d in range(width)])
        for c in range(len(centroids))
    ]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(
    rows: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: str = "1",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """The vectors that take part, and the final centroids.

    Columns: the id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of the cluster's centroid.
    """
    rows = pick(rows, id_col, vector_col)
    centroids = first_centroids(rows, k, width, scale, seed, id_col, vector_col)
    out = {id_col: type_of(rows, id_col), "cluster": "int", "distance": "bigint"}
    for _ in range(rounds if centroids else 0):
        summed = _sums(rows, centroids, width, scale, vector_col)
        centroids = [[s // n for s in total] if n else old for (n, _, total), old in zip(summed, centroids)]
    inertia = [total for _, total, _ in _sums(rows, centroids, width, scale, vector_col)] if centroids else []
    fixed = np.array(centroids, np.int64).reshape(len(centroids), width)

    def start():
        def work(ids, vectors):
            taken, x = matrix(vectors, width, scale)
            number, far = nearest(x, fixed) if len(fixed) else (np.empty(0, np.int64), np.empty(0, np.int64))
            return {
                id_col: ids.take(pa.array(taken)),
                "cluster": (number.astype(np.int32), pa.int32()),
                "distance": as_longs(far),
            }

        return work

    def of_cluster(values: list, kind: str) -> Column:
        listed = F.array(*map(F.lit, values)) if values else F.array().cast(f"array<{kind}>")
        return F.get(listed, F.col("cluster")).cast(kind)

    held = lambda v: min(v, (1 << 63) - 1)
    made = scan(rows, [id_col, vector_col], start, out, rows=ROWS)
    return made.select(
        id_col,
        "cluster",
        "distance",
        of_cluster([held(v) for v in inertia], "bigint").alias("cluster_inertia"),
        F.lit(held(sum(inertia))).cast("bigint").alias("inertia"),
        of_cluster([digest(c) for c in centroids], "string").alias("centroid_sha256"),
    ), centroids
