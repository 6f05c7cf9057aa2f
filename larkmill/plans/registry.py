"""All queries of the library with their DuckDB oracles, keyed by inventory id and short name."""

from __future__ import annotations

from . import evaluation, extensions, flows, models, sequences, statistics, tables  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(ORACLES)
