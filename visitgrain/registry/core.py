"""Registration of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitgrain.sources.visits import STAR_TABLES, VISITS_SQL, visits

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VISITS_CTE = "visits AS (" + VISITS_SQL.format(**{t: t for t in STAR_TABLES}).strip() + ")"


def _with_visits(sql: str) -> str:
    sql = sql.strip()
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {VISITS_CTE}, {sql[15:]}"
    if sql.startswith("WITH "):
        return f"WITH {VISITS_CTE}, {sql[5:]}"
    return f"WITH {VISITS_CTE} {sql}"


def add(key: str, query: Query, sql: str | None = None) -> None:
    """Register a query over the base tables."""
    if key in QUERIES:
        raise ValueError(f"{key} is registered twice")
    QUERIES[key] = query
    if sql is not None:
        ORACLES[key] = sql.strip()


def on_visits(key: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over the visits table; its SQL reads ``visits``."""
    add(key, lambda spark, sf_dir: plan(visits(spark, sf_dir)), sql and _with_visits(sql))


def rounded(df: DataFrame, *columns: str, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Double sums depend on the order of addition in the last bits; compare them rounded.

    ``nudge`` is added on both sides where exact halves are common, as in means of few values:
    it is larger than the noise and moves a half off the rounding boundary.
    """
    return df.withColumns({c: F.round(F.col(f"`{c}`") + nudge, digits) for c in columns})
