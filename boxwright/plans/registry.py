"""Query registry: one entry per inventory row, with its oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxwright.plans import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_bridges(sql: str) -> str:
    """Prefix the bridge views a statement mentions as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in bridge.VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    ctes = [f"{name} AS ({bridge.VIEWS[name]})" for name in needed]
    body = sql.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        return "WITH RECURSIVE " + ", ".join(ctes + [body[match.end():]])
    return ("WITH " + ", ".join(ctes) + " " + body) if ctes else body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an inventory name, with DuckDB SQL where the operator is expressible."""

    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_bridges(sql)
        return fn

    return register
