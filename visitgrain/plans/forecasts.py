"""Forecasts of the dashboard series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from visitgrain.forecast import arima
from visitgrain.plans import revenue, visits
from visitgrain.schema import REVENUE

#: Orders to choose from; None is the full space.
Orders = Sequence[arima.Order] | None


def visits_by_registration_type(
    v: DataFrame, *, horizon: int = 30, shared_order: bool = False, orders: Orders = None, **filters
) -> DataFrame:
    history = visits.registration_type_history(v, **filters)
    return arima.forecast(history, horizon, orders, order_from="first" if shared_order else None)


def revenue_by_registration_type(
    v: DataFrame, *, horizon: int = 30, shared_order: bool = False, orders: Orders = None, **filters
) -> DataFrame:
    history = revenue.registration_type_history(v, **filters)
    return arima.forecast(history, horizon, orders, order_from="first" if shared_order else None)


def revenue_and_cost(v: DataFrame, *, horizon: int = 30, orders: Orders = None, **filters) -> DataFrame:
    """Both measures with the order found for revenue."""
    return arima.forecast(revenue.measure_history(v, **filters), horizon, orders, order_from=REVENUE)
