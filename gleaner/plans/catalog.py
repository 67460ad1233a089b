"""The registry of named queries and of SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Which rows of the operator inventory a query exercises.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(function: Callable) -> Callable:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name], COVERS[name] = function, covers
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def load() -> None:
    from gleaner.plans import content, flows, graph, merges, pages, relational, retrieval, spatial, urls  # noqa: F401


load()
