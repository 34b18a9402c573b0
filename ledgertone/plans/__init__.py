"""The query registry; importing the package registers every query."""

from . import catalog_queries, change_queries, curve_queries, link_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
