"""Joins with the survey rules: missing keys match each other, keys are named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def _null_safe(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys where null equals null; one copy of each key comes out.

    Without keys the right side must be one row, whose values become constants of the left rows.
    """
    if not on:
        rows = b.take(2)
        if len(rows) > 1:
            raise ValueError("a join without keys takes a right side of one row")
        if not rows and how == "inner":
            return a.limit(0).select(*a.columns, *[F.lit(None).cast(t).alias(c) for c, t in b.dtypes])
        value = rows[0] if rows else [None] * len(b.columns)
        return a.select(*a.columns, *[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(value, b.dtypes)])
    right = b.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in on else F.col(f"`{c}`")
                       for c in b.columns])
    cond: Column | None = None
    for c in on:
        eq = a[c].eqNullSafe(right[f"__r_{c}"])
        cond = eq if cond is None else cond & eq
    joined = a.join(right, cond, how)
    keys = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__r_{c}`")).alias(c) if how == "full"
            else F.col(f"`{c}`") for c in on]
    rest = [F.col(f"`{c}`") for c in a.columns if c not in on]
    rest += [F.col(f"`{c}`") for c in b.columns if c not in on]
    return joined.select(*keys, *rest)


def natural_left(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Left join on all shared columns (or ``on``)."""
    return _null_safe(a, b, list(shared_columns(a, b) if on is None else on), "left")


def natural_inner(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    return _null_safe(a, b, list(shared_columns(a, b) if on is None else on), "inner")


def natural_full(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on all shared columns (or ``on``).

    Adaptive execution can split a skewed side of a left or anti join but not of a full outer join, so
    the result is a left join plus the right rows without a partner, whatever the keys are like.
    """
    on = list(shared_columns(a, b) if on is None else on)
    left = _null_safe(a, b, on, "left")
    # Partner test needs one row per key, so the probed side is reduced first.
    seen = a.select(*[F.col(f"`{c}`").alias(f"__k_{c}") for c in on]).distinct()
    cond = None
    for c in on:
        eq = b[c].eqNullSafe(seen[f"__k_{c}"])
        cond = eq if cond is None else cond & eq
    return left.unionByName(b.join(seen, cond, "left_anti"), allowMissingColumns=True)


def complete_grid(df: DataFrame, key: str, levels: dict[str, Sequence],
                  fill: dict | None = None) -> DataFrame:
    """Add the missing combinations of ``key`` with declared levels.

    The declared side is exploded from literals, so no product join is planned.
    """
    grid = df.select(key).distinct()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = natural_full(df, grid, [key, *levels])
    return out.fillna(fill) if fill else out


def bind_rows(frames: dict[str, DataFrame] | Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """Union by column name; a dict with ``tag`` records which table a row came from."""
    if isinstance(frames, dict):
        tables = [f.withColumn(tag, F.lit(k)) if tag else f for k, f in frames.items()]
    else:
        tables = list(frames)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
