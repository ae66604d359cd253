"""Queries over the provided tables, and their SQL."""

from . import decision_queries, effect_queries, state_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "decision_queries", "effect_queries", "state_queries", "text_queries"]
