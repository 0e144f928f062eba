"""All queries on the engine's own operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("scoring", "auditing", "runs", "statistics", "answers", "sources")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _topic in TOPICS:
    _module = import_module(f"veritally.plans.{_topic}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
