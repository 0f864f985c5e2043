"""Registration of queries and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORACLE_RAW: dict[str, str] = {}   # before the view CTEs are added

# Parameters shared by the registered report queries (FIXTURES.md §2).
AS_OF = "2001-08-01"
DAYS = 90


def with_views(sql: str) -> str:
    """Prefix the domain views a query mentions as CTEs (DuckDB only has the
    driver's base tables)."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for v in VIEW_SQL:
            if v not in used and re.search(rf"\b{v}\b", text):
                used.add(v)
                todo.append(VIEW_SQL[v])
    used = [v for v in VIEW_SQL if v in used]  # definition order = dependency order
    if not used:
        return sql
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE_RAW[key] = oracle
            ORACLE[key] = with_views(oracle)
        return fn
    return deco
