"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_p1", "queries_p2", "queries_p3", "queries_p4", "queries_p5", "queries_p6", "queries_p7")


def _modules():
    for name in MODULES:
        try:
            yield import_module(f"sparkloom.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"sparkloom.llm.{name}":
                raise


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
