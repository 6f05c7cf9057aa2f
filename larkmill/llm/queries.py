"""Queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {"op1_near_dedup": "minhash", "op2_decontaminate": "decontaminate", "op3_quality": "quality", "op4_toxicity": "toxicity", "op5_substring": "substring", "op6_url_filter": "urlfilter", "op7_secrets": "secrets", "op8_licenses": "licenses", "op9_bpe": "bpe", "op10_warc": "warc"}


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL expresses the operator."""
    found = {name: getattr(import_module(f".{module}", __package__), "oracle", None) for name, module in _QUERIES.items()}
    return {name: f() for name, f in found.items() if f}
