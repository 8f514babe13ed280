"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from tickloom.workload import (  # noqa: F401  (imports fill the registry)
    q_accounting,
    q_changes,
    q_cleaning,
    q_crosssection,
    q_estimators,
    q_joins,
    q_panels,
    q_reports,
    q_tables,
    q_weights,
)
from tickloom.workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
