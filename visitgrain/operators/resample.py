"""Bucketed series: truncation, dense gap filling, labels, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from visitgrain.functions.dates import bucket, bucket_label, step, text_label

PERIOD = "time_period"


def with_bucket(df: DataFrame, ts: str, freq: str, out: str = PERIOD) -> DataFrame:
    return df.withColumn(out, bucket(ts, freq))


def densify(
    series: DataFrame,
    freq: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    period: str = PERIOD,
    fill: float | None = 0,
) -> DataFrame:
    """Add the empty buckets between the first and last one of each key.

    ``series`` is aggregated already: one row per key and bucket. The spine comes from each key's
    first and last bucket, and the series is joined to it, so no task holds a whole series.
    """
    known = series.filter(F.col(period).isNotNull())
    ends = known.groupBy(*keys).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    # Without keys an empty series still gives one row of nulls, which has no buckets.
    spine = ends.filter(F.col("_first").isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.explode(F.sequence("_first", "_last", step(freq))).alias("_at"),
    )
    match = F.col("_at") == F.col(period)
    for i, k in enumerate(keys):
        match = match & F.col(f"_k{i}").eqNullSafe(F.col(k))
    zero = F.lit(fill)
    return spine.join(known, match, "left").select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_at").alias(period),
        *[F.coalesce(F.col(f"`{m}`"), zero).cast(series.schema[m].dataType).alias(m) for m in measures],
    )


def labelled(
    series: DataFrame,
    freq: str,
    label: str = "start",
    pattern: str = "yyyy-MM-dd",
    period: str = PERIOD,
) -> DataFrame:
    """Replace bucket starts by text labels and order by time."""
    named = series.orderBy(period)
    return named.withColumn(period, text_label(bucket_label(period, freq, label), pattern))


def align(index: DataFrame, other: DataFrame, on: Sequence[str] = (PERIOD,)) -> DataFrame:
    """``other`` at the rows of ``index``; null where it has none."""
    return index.join(other, list(on), "left")
