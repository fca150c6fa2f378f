"""Queries over the driver's tables and the SQL each of them must agree with."""

from touchline.catalog import (  # noqa: F401
    file_queries, result_queries, shot_queries, story_queries, text_queries,
)
from touchline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
