"""Shared by the vector operators: sound vectors as whole numbers, exact sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Whole components are held to this range.
MOST = 1 << 62
#: Vectors handed to numpy at a time.
ROWS = 2048


def sound(vector_col: str) -> Column:
    """True for vectors that hold neither null nor a component that is not finite."""
    one = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector_col, one), F.lit(False))


def whole(vector_col: str, scale: int, plus: int = 0) -> Column:
    """floor(scale * x) + plus of each component, as longs within the range."""
    held = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST))
    return F.transform(vector_col, lambda x: held(x) + F.lit(plus))


def matrix(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their floor(scale * x) as rows of longs) of an Arrow list column."""
    fits = pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), width)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = vectors.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(places), width)
    fine = np.isfinite(x).all(axis=1)
    x = np.clip(np.floor(x[fine] * scale), -MOST, MOST).astype(np.int64)
    return places[fine], x


def exact(x: np.ndarray, room: int) -> np.ndarray:
    """The numbers as longs where ``room`` times the square of the greatest stays within a long,
    as Python's integers otherwise."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(np.int64) if most * most * room < 1 << 62 else x.astype(object)


def as_longs(values: np.ndarray) -> pa.Array:
    """Whole numbers held to the range of a long."""
    if values.dtype == object:
        values = np.array([max(-(1 << 63), min(int(v), (1 << 63) - 1)) for v in values], np.int64)
    return pa.array(values, pa.int64())


def totals(df: DataFrame, add: Callable[[list[pa.Array], dict[int, int]], None]) -> dict[int, int]:
    """Exact whole-number totals over all rows.

    ``add(columns, sums)`` adds a batch to a task's sums by place. A task hands on one row for
    each place, as two halves of 32 bits and more, and Spark adds those up; only the totals reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                add(batch.slice(low, ROWS).columns, sums)
        places = list(sums)
        high, low = [sums[p] >> 32 for p in places], [sums[p] & 0xFFFFFFFF for p in places]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array(map(str, high), pa.string()), pa.array(low, pa.int64())],
            names=["place", "high", "low"],
        )

    made = df.mapInArrow(run, "place bigint, high string, low bigint")
    summed = made.groupBy("place").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low"))
    return {r.place: (int(r.high) << 32) + int(r.low) for r in summed.collect()}
