"""All named query plans, each a function of (spark, directory of tables) and, where SQL can say it, the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _counted(sql: str) -> str:
    """SQL with every count_if() as BIGINT, as Spark counts."""
    out, at = "", 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out += sql[at:start] + f"CAST({sql[start:end]} AS BIGINT)"
        at = end
    return out + sql[at:]


def plan(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _counted(sql)
        return f

    return register


def _loaded() -> None:
    from fathom.plans import code, documents, graphs, memory, seams, tools  # noqa: F401  they register their plans


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
