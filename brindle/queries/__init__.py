"""The query catalogue: one entry per operator, each with the SQL that checks it."""

from __future__ import annotations

from . import aggregates, keyed, relational, scalar, star, streams, system, windows
from .base import Entry

MODULES = (relational, aggregates, windows, scalar, keyed, system, streams, star)


def entries() -> dict[str, Entry]:
    found: dict[str, Entry] = {}
    for module in MODULES:
        for name, entry in module.ENTRIES.items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = entry
    return found
