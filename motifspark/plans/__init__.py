"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import comparison_queries, counted_queries, fit_queries, model_queries, sequence_queries, table_queries, tree_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "L1_log_likelihood"
