"""All registered queries."""

from . import queries_anomaly, queries_clean, queries_evaluation, queries_features, queries_models, queries_sources, queries_store, queries_streams, queries_trend  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
