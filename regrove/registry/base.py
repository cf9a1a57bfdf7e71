"""Registry plumbing: table reading, rounding on both sides, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL giving the same rows."""
    def keep(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn
    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def rnd(x, digits: int = 6) -> Column:
    """Rounded double with a single zero (no negative zero)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def out(df: DataFrame, *keep: str, digits: int = 6, **other: int) -> DataFrame:
    """Select columns, rounding doubles (``other`` overrides digits per column)."""
    types = dict(df.dtypes)
    cols = keep or df.columns
    return df.select(*[rnd(c, other.get(c, digits)).alias(c) if types[c] in ("double", "float") else F.col(c)
                       for c in cols])


def R(expr: str, digits: int = 6) -> str:
    """The SQL form of ``rnd``."""
    return f"(CASE WHEN round(CAST({expr} AS DOUBLE), {digits}) = 0 THEN 0.0 ELSE round(CAST({expr} AS DOUBLE), {digits}) END)"
