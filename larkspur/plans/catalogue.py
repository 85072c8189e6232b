"""All named queries of the library outside its optional subpackages."""

from __future__ import annotations

from . import Query, functional, relational

MODULES = [relational, functional]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
