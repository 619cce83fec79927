"""Registered queries of the ledger engine and their DuckDB counterparts."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
