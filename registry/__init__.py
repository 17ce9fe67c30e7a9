"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from . import bank_queries, ledger_queries, report_queries, source_queries
from .core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "bank_queries", "ledger_queries", "report_queries", "source_queries"]
