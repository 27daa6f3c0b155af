"""The registered queries: views over the given tables, Spark jobs and SQL twins."""

from . import (  # noqa: F401
    search_queries,
    storage_queries,
    text_queries,
    training_queries,
    vector_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
