"""Aggregate expressions chosen by name, and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

AGGREGATES: dict[str, Callable[[Column | str], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def aggregate_named(name: str) -> Callable[[Column | str], Column]:
    try:
        return AGGREGATES[name]
    except KeyError:
        raise ValueError(f"unknown aggregate: {name!r}") from None


def bankers_round(c: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(c, digits)


def difference_of_sums(gain: str, loss: str) -> Column:
    """``sum(gain) - sum(loss)``; a null on one side of a row still counts the other side."""
    return F.sum(gain) - F.sum(loss)
