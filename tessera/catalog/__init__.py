"""The queries of the driver contract: a function of (spark, sf_dir) and, as a rule, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def load() -> None:
    from tessera.catalog import branches, evidence, frames, graphs, more, relational, signatures, surface, texts, thoughts, timelines, walks, wide  # noqa: F401
