"""Registry of runnable queries, each with the DuckDB SQL that must give the same rows.

The output list of a query is written once, e.g. ``"session_id lap_number ~duration_s"``; a ``~`` marks a
double that both engines round to six places.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Name a reusable subquery; it is prepended to every oracle that mentions it."""
    CTES[name] = sql.strip()


def _needs(text: str) -> list[str]:
    """Named subqueries used by ``text``, each after those it uses itself."""
    found: list[str] = []

    def visit(fragment: str) -> None:
        for name in CTES:
            if name not in found and re.search(rf"\b{name}\b", fragment):
                visit(CTES[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def compose(sql: str) -> str:
    parts = [f"{name} AS ({CTES[name]})" for name in _needs(sql)]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def _fields(spec: str) -> list[tuple[str, bool]]:
    return [(f.lstrip("~"), f.startswith("~")) for f in spec.split()]


def _spark_cols(spec: str) -> list[Column]:
    return [
        (F.round(F.col(n), 6) + F.lit(0.0)).alias(n) if rounded else F.col(n)
        for n, rounded in _fields(spec)
    ]


def query(name: str, ids: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``ids`` are the inventory rows it covers."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*_spark_cols(spec))

        oracle = None
        if sql is not None:
            cols = ", ".join(
                f"round({n}, 6) + 0e0 AS {n}" if rounded else n for n, rounded in _fields(spec)
            )
            oracle = compose(f"SELECT {cols} FROM ({sql.strip()}) q")
        QUERIES[name] = Query(name, ids, run, oracle)
        return fn

    return register
