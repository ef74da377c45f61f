"""Predicates as Column expressions."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F


def year_bounds(year: int, month: int | None = None) -> tuple[dt.date, dt.date]:
    """Half-open day range of a year or of one month in it."""
    if month is None:
        return dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date(year, month, 1), after


def ntz(moment: Any) -> Column:
    """A Column holding a timestamp without time zone."""
    return (moment if isinstance(moment, Column) else F.lit(str(moment))).cast("timestamp_ntz")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


_COMPARISONS = {
    "equal": lambda c, v: c == v,
    "equals": lambda c, v: c == v,
    "less": lambda c, v: c < v,
    "lessEqual": lambda c, v: c <= v,
    "more": lambda c, v: c > v,
    "moreEqual": lambda c, v: c >= v,
    "isin": lambda c, v: c.isin(list(v)),
}


def column_predicate(column: str, rule: Any) -> Column:
    """One column's rule: a scalar, a list, or a dict of comparisons that must all hold."""
    c = F.col(column)
    if isinstance(rule, dict):
        unknown = set(rule) - set(_COMPARISONS)
        if unknown:
            raise ValueError(f"unknown comparison for {column}: {sorted(unknown)}")
        return all_of([_COMPARISONS[op](c, value) for op, value in rule.items()])
    if isinstance(rule, (list, tuple, set)):
        return c.isin(list(rule))
    return c == rule


def column_predicates(filters: dict[str, Any] | None) -> Column:
    return all_of([column_predicate(name, rule) for name, rule in (filters or {}).items()])
