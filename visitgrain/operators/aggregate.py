"""Aggregations. Every group key is reduced on the map side before it is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.functions.measures import aggregate_named, difference_of_sums
from visitgrain.schema import EVENT_TIME, PARTITION_MONTH, PARTITION_YEAR, PARTITIONS
from visitgrain.sources.summary import labels_of, summary_of


def count_by(df: DataFrame, *keys: str | Column, out: str = "count") -> DataFrame:
    """Rows per group. NULL is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def count_non_null_by(df: DataFrame, key: str, out: str = "count") -> DataFrame:
    """Non-null values per group, so the NULL group counts 0."""
    return df.groupBy(key).agg(F.count(key).alias(out))


def row_count(df: DataFrame, out: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def distinct_count(
    df: DataFrame, key: str, *by: str | Column, out: str = "count", rsd: float | None = None
) -> DataFrame:
    """Distinct non-null keys, per group if ``by`` is given.

    Exact by default; ``rsd`` asks for a HyperLogLog estimate with that relative error.
    """
    measure = F.count_distinct(key) if rsd is None else F.approx_count_distinct(key, rsd)
    return df.groupBy(*by).agg(measure.alias(out))


def sum_by(df: DataFrame, keys: Sequence[str | Column], **sums: str) -> DataFrame:
    """``sum_by(df, ["payer"], revenue="total")`` sums ``total`` as ``revenue``."""
    return df.groupBy(*keys).agg(*[F.sum(col).alias(out) for out, col in sums.items()])


def profit(df: DataFrame, gain: str, loss: str, *by: str, out: str = "profit") -> DataFrame:
    return df.groupBy(*by).agg(difference_of_sums(gain, loss).alias(out))


def average_by(df: DataFrame, keys: Sequence[str | Column], **averages: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(col).alias(out) for out, col in averages.items()])


def _commonest(value: str, n: str) -> Column:
    """Most frequent value among pre-counted rows; ties go to the smallest, nulls never win."""
    ranked = F.when(F.col(value).isNotNull(), F.struct((-F.col(n)).alias("n"), F.col(value).alias("v")))
    return F.min(ranked).getField("v")


def mode_by(
    df: DataFrame,
    keys: Sequence[str | Column],
    value: str,
    out: str = "mode",
    count_out: str | None = None,
) -> DataFrame:
    """Modal value per group, and the group's rows as ``count_out``.

    Counting (group, value) pairs first keeps each group's state to one row per distinct value
    and spreads a hot group over its values.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    names = [c for c in counted.columns if c not in (value, "_n")]
    measures = [_commonest(value, "_n").alias(out)]
    if count_out:
        measures.insert(0, F.sum("_n").alias(count_out))
    return counted.groupBy(*names).agg(*measures)


def mode_of(df: DataFrame, value: str, out: str = "mode") -> DataFrame:
    """Modal value of a whole column."""
    return mode_by(df, [], value, out)


def time_extent(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    return df.agg(F.min(ts).alias("min_time"), F.max(ts).alias("max_time"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    labels = labels_of(df, column)
    return df.select(column).distinct() if labels is None else labels


def _calendar(df: DataFrame, ts: str) -> tuple[Column, Column]:
    """Year and month of ``ts``; on a partitioned table the partition columns."""
    if ts == EVENT_TIME and set(PARTITIONS) <= set(df.columns):
        return F.col(PARTITION_YEAR), F.col(PARTITION_MONTH)
    return F.year(ts), F.month(ts)


def _months(df: DataFrame, ts: str) -> DataFrame:
    """The frame, or of a whole stored table its months."""
    months = summary_of(df) if ts == EVENT_TIME else None
    return df if months is None else months


def observed_calendar(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    """Distinct (year, month) pairs present."""
    df = _months(df, ts)
    year, month = _calendar(df, ts)
    return df.select(year.cast("long").alias("tahun"), month.cast("long").alias("bulan")).distinct()


def year_span(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    df = _months(df, ts)
    year, _ = _calendar(df, ts)
    return df.agg(F.min(year).cast("long").alias("first"), F.max(year).cast("long").alias("last"))


def year_range(df: DataFrame, ts: str = EVENT_TIME) -> DataFrame:
    """Every year from the first to the last event, gaps included."""
    span = year_span(df, ts).filter(F.col("first").isNotNull())
    return span.select(F.explode(F.sequence("first", "last")).alias("tahun"))


def aggregate_columns(df: DataFrame, columns: Sequence[str], agg: str) -> DataFrame:
    """One named aggregate over each column, one output row."""
    fn = aggregate_named(agg)
    return df.agg(*[fn(F.col(f"`{c}`")).alias(c) for c in columns])


def as_index_value(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn one wide row into (index, value) rows, nulls as 0."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("index"),
                F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("value"),
            )
            for c in columns
        ]
    )
    return row.select(F.inline(pairs))


def frequency(df: DataFrame, cats: Sequence[str], out: str = "count") -> DataFrame:
    """Rows per category combination, most frequent first; incomplete combinations dropped."""
    counted = count_by(df.na.drop(subset=list(cats)), *cats, out=out)
    return counted.orderBy(F.desc(out), *cats)


def ordered_cells(count: str, cells: Mapping[str, str]) -> Column:
    """Array of structs, most frequent first, then by label."""
    cell = F.struct(
        (-F.col(count)).alias("_o"), *[F.col(src).alias(name) for name, src in cells.items()]
    )
    ordered = F.array_sort(F.collect_list(cell))
    return F.transform(ordered, lambda x: F.struct(*[x[name].alias(name) for name in cells]))


def breakdown_json(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """One row holding ``[{name: value, "count": n}, …]``, most frequent first.

    Only the counted groups are gathered, one cell per distinct value.
    """
    counted = count_by(df, key, out="cnt")
    cells = ordered_cells("cnt", {name: key, "count": "cnt"})
    return counted.agg(
        F.when(F.count(F.lit(1)) > 0, F.to_json(cells, {"ignoreNullFields": "false"})).alias(out)
    )


def nested_records(
    df: DataFrame, outer: str, inner: str, count: str = "kunjungan", out: str = "records"
) -> DataFrame:
    """Per outer key, its inner keys with counts as an array of structs, sorted by inner key."""
    counted = count_by(df, outer, inner, out=count)
    return counted.groupBy(outer).agg(
        F.sort_array(F.collect_list(F.struct(inner, count))).alias(out)
    )
