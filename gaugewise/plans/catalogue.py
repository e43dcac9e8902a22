"""All registered queries."""

from gaugewise.plans import (  # noqa: F401
    queries_match,
    queries_results,
    queries_run,
    queries_scan,
    queries_series,
    queries_stream,
)
from gaugewise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
