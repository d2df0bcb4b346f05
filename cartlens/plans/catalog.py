"""All registered queries."""

from cartlens.plans import (  # noqa: F401
    chart_queries,
    cleaning_queries,
    metric_queries,
    questions,
    source_queries,
)
from cartlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
