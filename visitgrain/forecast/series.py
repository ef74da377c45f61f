"""Long series (series_key, time_period, value) and the arrays models are fitted on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.functions.dates import step
from visitgrain.operators.resample import PERIOD

KEY, VALUE = "series_key", "value"


def long_from_wide(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One long series per value column of a wide series frame."""
    columns = list(columns or [c for c in wide.columns if c != PERIOD])
    doubles = wide.select(PERIOD, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot([PERIOD], columns, KEY, VALUE)


def series_arrays(history: DataFrame, exog: Sequence[str] = ()) -> DataFrame:
    """One row per series: its points in time order.

    ``history`` is aggregated to buckets, so an array grows with the calendar (some thousand
    days), not with the number of visits.
    """
    columns = [PERIOD, VALUE, *exog]
    points = F.array_sort(F.collect_list(F.struct(*columns)))
    # The data is small but the fits are not: a fixed partition count keeps adaptive execution
    # from merging all series into one task. The grouping reuses this partitioning.
    tasks = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = history.na.drop(subset=columns).repartition(tasks, KEY)
    return spread.groupBy(KEY).agg(points.alias("points"))


def future_periods(last: Column, horizon: int, freq: str = "D") -> Column:
    """The ``horizon`` bucket starts that follow ``last``."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda i: (last + step(freq) * i).cast("timestamp_ntz")
    )
