"""Queries by name: the Spark plan, the inventory ids it covers, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    run: Callable
    ids: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ids: inventory ids, separated by spaces."""

    def keep(run: Callable) -> Callable:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, tuple(ids.split()), sql)
        return run

    return keep
