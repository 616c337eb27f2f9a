"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

QueryTable = dict[str, tuple[Callable, str | None]]


def registrar(table: QueryTable) -> Callable:
    """A decorator that puts a function into ``table`` under its own name, with its SQL if it has any."""

    def query(sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            table[f.__name__] = (f, sql)
            return f

        return put

    return query
