"""The generic query: time column, categories, measures, filters, frequency, pivot, aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.forecast import smoothing, trend
from visitgrain.forecast.series import long_from_wide
from visitgrain.functions.dates import bucket, parse_frequency, text_label
from visitgrain.functions.measures import aggregate_named
from visitgrain.functions.predicates import all_of
from visitgrain.operators import aggregate as agg_ops, reshape
from visitgrain.operators.filters import time_filter, where as where_filter
from visitgrain.operators.resample import PERIOD, densify, labelled
from visitgrain.schema import EVENT_TIME, PARTITIONS, PRESET_CUBES

Hook = Callable[[DataFrame], DataFrame]
MODES = ("raw", "series", "aggregate", "series_aggregate", "forecast")
_SUMMARIES = ("sum", "mean")


def default_label(freq: str) -> str:
    """Weeks and longer buckets are named by their last day, unless the code ends in S."""
    _, unit = parse_frequency(freq)
    return "start" if unit in ("hour", "day") or freq.endswith("S") else "end"


def _category(cats: Sequence[str]) -> Column:
    """One label for a combination of categories; null if any is null."""
    return F.col(cats[0]) if len(cats) == 1 else reshape.combined_label(cats)


def _counts(rows: DataFrame, ts: str, freq: str, agg: str, labels: Sequence[str]) -> DataFrame:
    """Rows per category. The mean is over distinct timestamps, so it needs both levels."""
    known = rows.filter(F.col("_cat").isNotNull())
    period = bucket(ts, freq).alias(PERIOD)
    if agg == "sum":
        return reshape.pivot_count(known, [period], "_cat", labels, fill=True)
    per_time = reshape.pivot_count(known, [F.col(ts)], "_cat", labels, fill=True)
    fn = aggregate_named(agg)
    return per_time.groupBy(period).agg(*[fn(F.col(f"`{c}`")).alias(c) for c in labels])


def _counts_and_measures(
    rows: DataFrame, ts: str, freq: str, agg: str, labels: Sequence[str], measures: Sequence[str], compat: bool
) -> DataFrame:
    """Category counts beside measures, per bucket.

    By default both sides are aggregated to the bucket and matched there, every bucket kept.
    ``compat`` instead matches each timestamp's counts to every raw row with that timestamp, which
    multiplies the counts by the rows sharing it and loses timestamps without a category; the
    product is computed from per-timestamp totals, so the multiplied rows never exist.
    """
    fine = bucket(ts, freq) if agg == "sum" and not compat else F.col(ts)
    cells = rows.groupBy(fine.alias("_t"), "_cat").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(m).alias(f"_s{i}") for i, m in enumerate(measures)],
        *[F.count(m).alias(f"_k{i}") for i, m in enumerate(measures)],
    )
    summed = [f"_{kind}{i}" for i in range(len(measures)) for kind in "sk"]
    per_time = cells.groupBy("_t").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_cat").isNotNull(), F.col("_n")).otherwise(0)).alias("_known"),
        *[F.sum(F.when(F.col("_cat") == c, F.col("_n")).otherwise(0)).alias(f"_c{j}") for j, c in enumerate(labels)],
        *[F.sum(c).alias(c) for c in summed],
    )
    weight = F.col("_n") if compat else F.lit(1)
    if compat:
        per_time = per_time.filter(F.col("_known") > 0)
    present = F.when(F.col("_known") > 0, weight)

    def count_cell(j: int) -> Column:
        total = F.sum(F.col(f"_c{j}") * weight)
        return total if agg == "sum" else total / F.sum(present)

    def measure_cell(i: int) -> Column:
        total = F.sum(f"_s{i}")
        return total if agg == "sum" else F.try_divide(total, F.sum(f"_k{i}"))

    return per_time.groupBy(bucket("_t", freq).alias(PERIOD)).agg(
        *[count_cell(j).alias(c) for j, c in enumerate(labels)],
        *[measure_cell(i).alias(m) for i, m in enumerate(measures)],
    )


def cube_series(
    rows: DataFrame,
    ts: str,
    cats: Sequence[str] = (),
    measures: Sequence[str] = (),
    *,
    freq: str = "D",
    agg: str = "sum",
    pivot: bool = False,
    labels: Sequence[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Wide series, one row per bucket that has rows."""
    if not cats and not measures:
        raise ValueError("cats or measures is required")
    if agg not in _SUMMARIES:
        raise ValueError(f"agg must be one of {_SUMMARIES}, not {agg!r}")
    if not cats:
        fn = aggregate_named(agg)
        return rows.groupBy(bucket(ts, freq).alias(PERIOD)).agg(*[fn(m).alias(m) for m in measures])
    rows = rows.withColumn("_cat", _category(cats))
    labels = reshape.categories(rows, "_cat") if labels is None else list(labels)
    if not measures:
        return _counts(rows, ts, freq, agg, labels)
    if pivot:
        return reshape.pivot_mean_then(
            rows, ts, bucket(ts, freq), "_cat", measures, labels, aggregate_named(agg)
        )
    return _counts_and_measures(rows, ts, freq, agg, labels, measures, compat)


def cube_aggregate(
    rows: DataFrame, cats: Sequence[str] = (), measures: Sequence[str] = (), *, agg: str = "sum", pivot: bool = False
) -> DataFrame:
    """Without time: frequencies, measure totals, or both per category."""
    if not cats and not measures:
        raise ValueError("cats or measures is required")
    if not cats:
        return agg_ops.as_index_value(agg_ops.aggregate_columns(rows, measures, agg), measures)
    if not measures:
        return agg_ops.frequency(rows, cats)
    if pivot:
        return reshape.category_mean_totals(rows, cats, measures, agg)
    fn = aggregate_named(agg)
    per_category = rows.na.drop(subset=list(cats)).groupBy(*cats)
    return per_category.agg(F.count(F.lit(1)).alias("count"), *[fn(m).alias(m) for m in measures])


def cube(
    df: DataFrame,
    ts: str = EVENT_TIME,
    cats: Sequence[str] = (),
    measures: Sequence[str] = (),
    *,
    mode: str = "raw",
    freq: str = "D",
    agg: str = "sum",
    pivot: bool = False,
    filters: dict[str, Any] | None = None,
    year: int | None = None,
    month: int | None = None,
    relative: str | None = None,
    start: Any = None,
    end: Any = None,
    pattern: str = "yyyy-MM-dd",
    label: str | None = None,
    labels: Sequence[str] | None = None,
    compat: bool = False,
    models: DataFrame | None = None,
    holdout: int = 30,
    horizon: int | None = None,
    ordered: bool = True,
    preprocess: Hook | None = None,
    postprocess: Hook | None = None,
) -> DataFrame:
    """Filter by time and predicates, then answer in one of ``MODES``.

    ``labels`` lists the category columns when they are known beforehand; otherwise a pass over
    the category column finds them. ``models`` are trend models to score in forecast mode; without
    them the series is smoothed exponentially, ``holdout`` last buckets aside. Raw rows come in
    time order, a sort of everything that is kept; ``ordered=False`` leaves it out.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    rows = preprocess(df) if preprocess else df
    wanted = dict.fromkeys([ts, *cats, *measures])
    carried = [p for p in PARTITIONS if p in rows.columns and ts == EVENT_TIME]
    rows = rows.select(*dict.fromkeys([*wanted, *(filters or {}), *carried]))
    rows = time_filter(rows, ts, year=year, month=month, relative=relative, start=start, end=end)
    rows = where_filter(rows, filters).select(*wanted)
    shape = dict(freq=freq, agg=agg, pivot=pivot, labels=labels, compat=compat)

    if mode == "raw":
        out = postprocess(rows) if postprocess else rows
        out = out.orderBy(ts) if ordered else out
        return out.na.fill(0).withColumn(ts, text_label(ts, pattern))
    if mode == "aggregate":
        return cube_aggregate(rows, cats, measures, agg=agg, pivot=pivot)
    wide = cube_series(rows, ts, cats, measures, **shape)
    columns = [c for c in wide.columns if c != PERIOD]
    if mode == "series_aggregate":
        # Empty buckets add nothing to a sum and are left out of a mean: no gap filling.
        return agg_ops.as_index_value(agg_ops.aggregate_columns(wide, columns, agg), columns)
    dense = densify(wide, freq, columns)
    if mode == "series":
        return labelled(dense, freq, label or default_label(freq), pattern)
    history = long_from_wide(dense, columns)
    if models is not None:
        future = trend.score_since(models, history, horizon or 30)
    else:
        future = smoothing.forecast(history, holdout, horizon or 90, freq)
    return future.withColumn(PERIOD, text_label(PERIOD, pattern))


def preset(df: DataFrame, name: str, **options) -> DataFrame:
    """One of the preset cubes; ``options`` are passed on to ``cube``."""
    given = PRESET_CUBES[name]
    fixed = given.get("where")
    hook = (lambda d: where_filter(d, fixed)) if fixed else None
    return cube(df, EVENT_TIME, given["cats"], given["measures"], preprocess=hook, **options)
