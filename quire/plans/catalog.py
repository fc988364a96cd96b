"""All queries of the reference's operators."""

from quire.plans import clean_queries, data_queries, eval_queries, layout_queries, text_queries  # noqa: F401
from quire.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
