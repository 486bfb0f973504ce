"""All queries of the core and their SQL."""

from __future__ import annotations

from riskframe.plans import core, facets, training

_MODULES = (training, core, facets)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
