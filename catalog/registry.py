"""Query name -> Spark function, and query name -> SQL over the same tables."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sql_with(parts: list[str], body: str) -> str:
    """Named subqueries and a final select."""
    return f"WITH {', '.join(parts)} {body}"
