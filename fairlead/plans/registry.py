"""Every query of the vessel-traffic side, with its reference SQL."""

from __future__ import annotations

from fairlead.plans import decoding, evaluating, traffic, watching

_MODULES = (traffic, decoding, watching, evaluating)


def queries() -> dict:
    """Query name -> function of (spark, directory of the tables)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
