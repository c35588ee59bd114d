"""All registered queries."""

from slipwatch.plans import queries_files, queries_forms, queries_ingest, queries_metrics, queries_models, queries_panel  # noqa: F401
from slipwatch.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
