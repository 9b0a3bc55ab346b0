"""All registered queries."""

from . import catalogue, context_queries, evaluation_queries, graph_queries, local_queries, method_queries, result_queries, scoped_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "context_queries", "evaluation_queries", "graph_queries", "local_queries", "method_queries", "result_queries", "scoped_queries"]
