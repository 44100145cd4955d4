"""All registered queries and their SQL twins."""

from __future__ import annotations

from tripweave.plans import articles, changelog, checks, merges, planning, readmodels, search, weather

_MODULES = (weather, articles, readmodels, planning, changelog, merges, checks, search)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
