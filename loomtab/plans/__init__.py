"""Queries and the SQL they are held against, by subject."""

from __future__ import annotations

from . import catalog, events, files, flows, memory, requests, stages, stats, texts

_MODULES = (files, catalog, events, stages, stats, requests, memory, flows, texts)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
