"""Import every query module, so that the registry is complete."""

from catalog import cleaning_queries, geometry_queries, join_queries, result_queries, storage_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
