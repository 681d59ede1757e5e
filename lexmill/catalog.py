"""All queries of the engine: importing this module registers them."""

from __future__ import annotations

from lexmill.plans import chunking_queries, conversation_queries, evaluation_queries, formatting_queries, graph_queries, pipeline_queries, retrieval_queries, stage_queries, surface_queries, verification_queries  # noqa: F401
from lexmill.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
