"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns for engine-independent comparison (and turn -0.0 into 0.0)."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"duplicate columns: {sorted(c for c in df.columns if df.columns.count(c) > 1)}")
    out = []
    for f in df.schema.fields:
        c = df[f.name]
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)
