"""All registered queries of the library."""

from encodelens.plans import cost_queries, document_queries, fleet_queries, quality_queries, stage_queries  # noqa: F401
from encodelens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
