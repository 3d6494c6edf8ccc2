"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` is DuckDB SQL for the same rows."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    """Six digits, as the SQL has them; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + 0.0


def row(spark: SparkSession, report: dict) -> DataFrame:
    """A report of numbers as one row."""
    return spark.createDataFrame([{k: v for k, v in report.items() if isinstance(v, (int, float))}])
