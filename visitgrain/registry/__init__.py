"""All checked queries, by the identifiers of the operator inventory."""

from visitgrain.registry import dashboards, operators, pipelines
from visitgrain.registry.core import ORACLES, QUERIES

for _family in (dashboards, operators, pipelines):
    _family.register()

__all__ = ["ORACLES", "QUERIES"]
