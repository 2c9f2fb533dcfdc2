"""The registered queries of every operator family."""

from clickloom.plans import base_sql, q_clean, q_eda, q_features, q_negatives, q_recommend, q_sequences  # noqa: F401  (registration on import)
from clickloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
