"""The registered queries of the core library and their SQL."""

from .oracle import ORACLE_SQL
from .search import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
