"""Registered checks: a Spark query per operator and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _tokens(spec: str) -> list[tuple[str, str]]:
    return [(t.rstrip(":#"), t[-1] if t[-1] in ":#" else "") for t in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Columns of the result: ``name:`` is rounded to 6 digits, ``name#`` a whole number."""
    kinds = {
        ":": lambda c: (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c),
        "#": lambda c: F.col(c).cast("bigint").alias(c),
        "": F.col,
    }
    return df.select(*[kinds[k](c) for c, k in _tokens(spec)])


def final(spec: str, source: str) -> str:
    kinds = {
        ":": lambda c: f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}",
        "#": lambda c: f"CAST({c} AS BIGINT) AS {c}",
        "": lambda c: c,
    }
    return "SELECT " + ", ".join(kinds[k](c) for c, k in _tokens(spec)) + f" FROM {source}"
