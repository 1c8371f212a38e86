"""Imports every module that registers queries."""

from heatloom.plans import feature_queries, graph_queries, model_queries, row_queries, source_queries, text_queries  # noqa: F401
from heatloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
