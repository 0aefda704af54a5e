"""Query registry: a name, a Spark plan, and where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r(col: Column | str, n: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, n)


def rounded(df, cols, n: int = 6):
    """Round the named columns in place, keep the others."""
    cols = set(cols)
    return df.select(*[r(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])
