"""Import every query module, so that the registry is complete."""

from quoin.llm import match_queries, model_queries, shape_queries, token_queries, url_queries  # noqa: F401
from quoin.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
