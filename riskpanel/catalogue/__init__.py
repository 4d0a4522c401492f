"""Registered queries over the driver tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("panel", "activity", "archive", "incidents", "identity", "bundle", "ranking", "cohort", "learning", "explain", "storage", "streams")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def exact_rounding(sql: str) -> str:
    """``round_even(x, n)`` of the checks as correctly rounded text, which rounds the binary value of x."""
    mark = "round_even("
    while mark in sql:
        start = sql.index(mark)
        depth, end = 1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, digits = sql[start + len(mark) : end - 1].rsplit(",", 1)
        sql = f"{sql[:start]}(CAST(printf('%.{int(digits)}f', CAST(({value}) AS DOUBLE)) AS DOUBLE) + 0.0){sql[end:]}"
    return sql


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return query

    return add


def load_all() -> None:
    """Import every catalogue module so that its queries register."""
    for module in MODULES:
        import_module(f"riskpanel.catalogue.{module}")
