"""Registration of hand-made cases: a function from session to rows next to the SQL of what they must be."""

from __future__ import annotations

from collections.abc import Callable

CASES: dict[str, tuple[Callable, str | None]] = {}


def case(sql: str | None = None):
    def register(f: Callable) -> Callable:
        CASES[f.__name__] = (f, sql)
        return f

    return register
