"""Column names that clash with none of a caller's."""

from __future__ import annotations


def unused(taken: list[str], *names: str) -> list[str]:
    """``names`` with so many marks before them that none is among ``taken``, in any case."""
    used = {c.lower() for c in taken}
    mark = "_"
    while any((mark + n).lower() in used for n in names):
        mark += "_"
    return [mark + n for n in names]
