"""All named queries; importing the query modules registers them."""

from lociframe.plans import align_queries, coalescent_queries, io_queries, trace_queries, tree_queries  # noqa: F401
from lociframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
