"""All queries of the library and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

from assurance.plans.decisions import flagship

MODULES = ["decisions", "projected", "retrieval", "turns", "logs_and_streams", "reported", "further"]

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"assurance.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"assurance.plans.{m}").SQL.items()}
