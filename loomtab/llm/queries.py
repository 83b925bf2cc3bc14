"""The queries and SQL of this package, gathered from its modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from . import bpe, decontaminate, divergence, lines, minhash, pii, quality, resampling, sharding, simhash, substrings, token_files, toxicity
from .tables import settled

_MODULES = (bpe, decontaminate, divergence, lines, minhash, pii, quality, resampling, sharding, simhash, substrings, token_files, toxicity)


def _settled(name: str, query: Callable) -> Callable:
    """The query with its result as a table, and nothing else left in the shared folder."""
    return wraps(query)(lambda spark, sf_dir: settled(spark, name, lambda: query(spark, sf_dir)))


def queries() -> dict:
    return {name: _settled(name, f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
