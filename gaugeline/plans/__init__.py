"""Registered plans: one Spark query and one DuckDB oracle per operator."""

from gaugeline.plans.catalog import QUERIES, ORACLES
from gaugeline.plans import catalog_sources as _sources  # noqa: F401  (registers)
from gaugeline.plans import catalog_requests as _requests  # noqa: F401  (registers)
from gaugeline.plans import catalog_streams as _streams  # noqa: F401  (registers)

__all__ = ["QUERIES", "ORACLES"]
