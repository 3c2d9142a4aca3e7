"""Where queries register: a name, the function over (spark, sf_dir), and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name; without sql the driver only looks at its rows."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def contains_sql(column: str, words) -> str:
    """`column holds any of words` as SQL."""
    return "(" + " OR ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


def count_sql(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{quoted(w)}') AS INT)" for w in words) + ")"


def starts_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{quoted(w)}')" for w in words) + ")"


def quoted(word: str) -> str:
    return word.replace("'", "''")
