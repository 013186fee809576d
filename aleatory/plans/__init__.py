"""Registered queries and their DuckDB equivalents."""

from . import device_queries, estimator_queries, experiment_queries, flow_queries, lexicon_queries, more_queries, protocol_queries, trial_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "device_queries", "estimator_queries", "experiment_queries", "flow_queries", "lexicon_queries", "more_queries", "protocol_queries", "trial_queries"]
