"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from fairlead.llm import chat, media, mixing, packing, pii, quality, simhash, substring_dedup, token_count, url_filter

_MODULES = (url_filter, substring_dedup, media, pii, token_count, simhash, chat, packing, quality, mixing)


def queries() -> dict:
    """Query name -> function of (spark, directory of the tables)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
