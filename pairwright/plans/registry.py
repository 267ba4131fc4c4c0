"""Registry of runnable queries, each with the SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Named sub-queries in the order in which they may refer to one another.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def _closure(names: tuple[str, ...]) -> list[str]:
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n not in seen:
            for x in CTES[n][0]:
                visit(x)
            seen.add(n)

    for n in names:
        visit(n)
    return [n for n in CTES if n in seen]


def with_ctes(sql: str, *names: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in _closure(names)]
    if not parts:
        return sql
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head) :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(key: str, sql: str | None = None, *needs: str):
    """Register a query; sql None where SQL can't express it."""

    def add(f):
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = with_ctes(sql, *needs)
        return f

    return add
