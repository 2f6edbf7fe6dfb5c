"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from tilewright.plans import files, genome, problems, signals

MODULES = [problems, genome, signals, files]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
