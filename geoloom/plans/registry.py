"""All queries of the engine's own operators with their SQL equivalents, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

#: Each module has QUERIES (name -> callable) and ORACLE (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("pixel", "scene", "intake", "geometry", "polygons", "change", "vectors", "learning", "gates", "frames", "grid", "stream")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"geoloom.plans.{name}"), attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
