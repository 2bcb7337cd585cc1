"""Where plan modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a (spark, sf_dir) -> DataFrame function, with the SQL that it must equal."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put
