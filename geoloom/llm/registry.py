"""Queries and SQL of the corpus operators, one module each."""

from __future__ import annotations

from importlib import import_module

#: Each module has QUERIES (name -> callable) and ORACLE (name -> DuckDB SQL).
MODULES = (
    "telephony",
    "sharding",
    "bpe",
    "urls",
    "lines",
    "simhash",
    "suffixes",
    "templates",
    "pii",
    "language",
    "dualtree",
    "trie",
    "bitslices",
)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"geoloom.llm.{name}"), attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
