"""Pivots, unions and column-major payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from visitgrain.operators.resample import PERIOD
from visitgrain.sources.summary import labels_of


def categories(df: DataFrame, cat: str) -> list[str]:
    """Sorted non-null labels of a pivot column.

    These become column names, so they have to be known before planning: one pass over the column.
    Of a whole stored table they come from its summary. Callers that know the labels give them
    instead; for labels without end there is ``long_count``.
    """
    known = labels_of(df, cat)
    df = df if known is None else known
    return sorted(row[0] for row in df.filter(F.col(cat).isNotNull()).select(cat).distinct().collect())


def long_count(df: DataFrame, keys: Sequence[str | Column], cat: str, out: str = "n") -> DataFrame:
    """Rows per key and category as rows: what a pivot says, for any number of labels."""
    return df.filter(F.col(cat).isNotNull()).groupBy(*keys, cat).agg(F.count(F.lit(1)).alias(out))


def combined_label(cats: Sequence[str], sep: str = "|") -> Column:
    """One label for several categories, null if any is null.

    A separator or backslash inside a label is written with a backslash before it, so different
    combinations never share a label.
    """
    parts = [F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep)) for c in cats]
    return F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:])


def _finish(wide: DataFrame, keys: Sequence[str | Column], fill: bool) -> DataFrame:
    made = wide.columns[len(keys) :]
    return wide.na.fill(0, subset=made) if fill else wide


def pivot_count(
    df: DataFrame,
    keys: Sequence[str | Column],
    cat: str,
    values: Sequence[str] | None = None,
    fill: bool = False,
) -> DataFrame:
    """Rows per key and category, one column per category.

    Give ``values`` when the labels are known: otherwise one extra pass over the category column
    finds them. Combinations without rows are null, or 0 with ``fill``.
    """
    values = categories(df, cat) if values is None else list(values)
    wide = df.groupBy(*keys).pivot(cat, values).agg(F.count(F.lit(1)))
    return _finish(wide, keys, fill)


def pivot_measure(
    df: DataFrame,
    keys: Sequence[str | Column],
    cat: str,
    measure: Column,
    values: Sequence[str] | None = None,
    fill: bool = False,
) -> DataFrame:
    """Like ``pivot_count`` with any aggregate, such as ``F.sum("x")``."""
    values = categories(df, cat) if values is None else list(values)
    wide = df.groupBy(*keys).pivot(cat, values).agg(measure)
    return _finish(wide, keys, fill)


def pivot_mean_then(
    df: DataFrame,
    ts: str,
    period: Column,
    cat: str,
    measures: Sequence[str],
    values: Sequence[str] | None = None,
    agg: Callable[[Column], Column] = F.sum,
) -> DataFrame:
    """Mean per raw timestamp and category, then ``agg`` of those means per bucket.

    Missing (timestamp, category) cells count as 0. The two levels stay apart: a sum of means is
    not a sum. Columns are named by category, or ``measure_category`` for several measures.
    """
    known = df.filter(F.col(cat).isNotNull()).na.drop("all", subset=list(measures))
    values = categories(known, cat) if values is None else list(values)
    means = known.groupBy(ts).pivot(cat, values).agg(*[F.avg(m).alias(m) for m in measures])
    if len(measures) == 1:
        names = {v: v for v in values}
    else:
        names = {f"{v}_{m}": f"{m}_{v}" for m in measures for v in values}
    filled = means.na.fill(0, subset=list(names))
    return filled.groupBy(period.alias(PERIOD)).agg(
        *[agg(F.col(f"`{made}`")).alias(name) for made, name in names.items()]
    )


def category_mean_totals(
    df: DataFrame, cat: Sequence[str], measures: Sequence[str], agg: str = "sum", out: str = "value"
) -> DataFrame:
    """Mean of each measure per category, then the sum (or mean) over the measures."""
    means = df.na.drop(subset=list(cat)).groupBy(*cat).agg(*[F.avg(m).alias(m) for m in measures])
    present = [F.col(m).isNotNull().cast("int") for m in measures]
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in measures), F.lit(0.0))
    if agg == "mean":
        total = total / F.nullif(sum(present, F.lit(0)), F.lit(0))
    elif agg != "sum":
        raise ValueError(f"unknown aggregate: {agg!r}")
    return means.select(*cat, F.coalesce(total, F.lit(0.0)).alias(out))


def unstack_count(
    df: DataFrame,
    keys: Sequence[str | Column],
    cats: Sequence[str],
    values: Sequence[str] | None = None,
    sep: str = "|",
) -> DataFrame:
    """Counts with one column per combination of several categories, 0 where absent."""
    joined = df.na.drop(subset=list(cats)).withColumn("_cats", combined_label(cats, sep))
    values = categories(joined, "_cats") if values is None else list(values)
    return _finish(joined.groupBy(*keys).pivot("_cats", values).agg(F.count(F.lit(1))), keys, True)


def columnar_payload(
    wide: DataFrame, index: str = PERIOD, columns: Sequence[str] | None = None, pattern: str | None = None
) -> DataFrame:
    """One row of arrays: ``index``, ``columns`` and one list of values per column.

    For display-sized aggregates only: one cell per bucket and column.
    """
    columns = list(columns or [c for c in wide.columns if c != index])
    cells = F.struct(F.col(index), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    rows = wide.agg(F.array_sort(F.collect_list(cells)).alias("_r"))

    def label(cell: Column) -> Column:
        return F.date_format(cell[index], pattern) if pattern else cell[index]

    def values_of(column: str) -> Column:
        return F.transform("_r", lambda cell: F.coalesce(cell[column], F.lit(0.0)))

    return rows.select(
        F.transform("_r", label).alias("index"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.array(*[values_of(c) for c in columns]).alias("values"),
    )


def union_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null."""
    return old.unionByName(new, allowMissingColumns=True)


def melt(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str, value: str) -> DataFrame:
    """Measures as rows: one (name, value) pair per measure."""
    return df.unpivot(list(keys), list(measures), name, value)
