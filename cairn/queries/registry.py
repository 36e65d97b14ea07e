"""A query and its SQL check, registered together."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
