"""Queries of the analytics engine by name, with the SQL that must give the same rows."""

from .plans.engine import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
