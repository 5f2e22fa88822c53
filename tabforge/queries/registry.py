"""Query catalogue: one Spark builder and (where SQL can say it) one oracle
SQL text per operator id. ``__spark_entry__`` re-exports both maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.columns import quoted

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def rnd(c: Column, digits: int) -> Column:
    """Round a double for comparison; +0.0 turns -0.0 into 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every double column (or ``cols``) of a result."""
    names = cols if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select([rnd(quoted(c), digits).alias(c) if c in names else quoted(c)
                      for c in df.columns])


def R(expr: str, digits: int) -> str:
    """SQL counterpart of ``rnd``."""
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
