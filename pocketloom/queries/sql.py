"""Pieces of SQL that the queries' counterparts share."""

from __future__ import annotations

from pocketloom.runtime import SPACE

_SPACE = " || ".join(f"chr({ord(c)})" for c in SPACE)


def trim(column: str) -> str:
    """As runtime.trimmed: without surrounding white space, blank as null."""
    return f"nullif(trim({column}, {_SPACE}), '')"
