"""Registered queries over the given tables, with SQL that tells their results."""

from __future__ import annotations

from tessera.plans import ingest, search, state

_REGISTRIES = (search.registry, state.registry, ingest.registry)
QUERIES = {name: query for r in _REGISTRIES for name, query in r.queries.items()}
ORACLE_SQL = {name: sql for r in _REGISTRIES for name, sql in r.sql.items()}
