"""Registered queries."""

from plumbline.plans.registry import ORACLES, QUERIES
from plumbline.plans import signal_queries, text_queries, retrieval_queries, quality_queries, model_queries, workflow_queries, search_queries, source_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
