"""All queries over the engine's operators, gathered from the modules of glossa.plans."""

from __future__ import annotations

import importlib

from glossa.plans.registry import ENTRIES

MODULES = ("text", "references", "phrases", "relational", "search", "quality", "store", "sampling", "ranking", "events", "sources")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"glossa.plans.{name}")


def queries():
    _load()
    return {name: entry.run for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}


def coverage() -> dict[str, list[str]]:
    """Inventory ids and the queries that exercise them."""
    _load()
    found: dict[str, list[str]] = {}
    for name, entry in ENTRIES.items():
        for i in entry.ids:
            found.setdefault(i, []).append(name)
    return found
