"""The engine's queries over the driver's tables, each with SQL that says the same where SQL can."""

from quillgraph.plans import composites, entity_queries, graph_queries, health_queries, link_queries, map_queries, more_queries, person_queries, publish_queries, record_queries, resolution_queries, sheet_queries, store_queries, stream_queries, text_queries, version_queries  # noqa: F401
from quillgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
