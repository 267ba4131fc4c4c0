"""All queries of the engine and the SQL of those that SQL can express."""

from . import q_metrics, q_models, q_relational, q_scalar, q_sources, q_windows  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
