"""Ordering, limits and one-row-per-key selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def top_k(df: DataFrame, measure: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k greatest; equal measures are ordered by key. A null measure ranks first."""
    return df.orderBy(F.desc_nulls_first(measure), *[F.asc_nulls_first(c) for c in keys]).limit(k)


def bottom_k(df: DataFrame, measure: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k smallest, shown greatest first."""
    least = df.orderBy(F.asc_nulls_last(measure), *[F.desc_nulls_last(c) for c in keys]).limit(k)
    return ranked(least, measure, keys)


def ranked(df: DataFrame, measure: str, keys: Sequence[str]) -> DataFrame:
    """Whole frame ordered by the measure, greatest first."""
    return df.orderBy(F.desc_nulls_first(measure), *[F.asc_nulls_first(c) for c in keys])


def sort_measure(sort: str, allowed: Sequence[str]) -> str:
    if sort not in allowed:
        raise ValueError(f"sort must be one of {list(allowed)}, not {sort!r}")
    return sort


def distinct_on(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The distinct key combinations, NULL counting as a value."""
    return df.select(*keys).distinct()


def first_per_key(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Earliest row of each key, ties broken by the remaining columns; a null time comes last.

    An ordered minimum instead of a window: it combines on the map side, so a key with very many
    rows is never gathered in one place.
    """
    rest = [c for c in (columns or df.columns) if c not in keys and c != ts]
    firsts = df.groupBy(*keys).agg(
        F.min(F.struct(F.col(ts).isNull().alias("_late"), ts, *rest)).alias("_first")
    )
    return firsts.select(*keys, *[F.col("_first")[c].alias(c) for c in [ts, *rest]])


def first_event(df: DataFrame, key: str, ts: str, out: str = "first_time") -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias(out))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
