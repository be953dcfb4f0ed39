"""All queries of the core, by name."""

from __future__ import annotations

from framewright.plans import duplicates, evaluation, loading, references, routing

MODULES = (references, duplicates, routing, evaluation, loading)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
