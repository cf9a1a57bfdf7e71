"""Group summaries placed beside rows, dominant rows, tallies and numbering.

Raw tables may have one key holding a third of all rows, so group values are
computed by a partially aggregated ``groupBy`` and joined back: the per-key side
is small and unique, which lets adaptive execution split the hot side.  Windows
are used only where a group is bounded by design (the species of one plot).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .joins import natural_inner, natural_left


def with_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Each row with aggregates of its group."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return natural_left(df, stats, keys)


def with_group_bounded(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """As ``with_group`` for groups of bounded size: one shuffle, no second scan."""
    w = Window.partitionBy(*keys)
    return df.withColumns({n: c.over(w) for n, c in aggs.items()})


def dominant(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Rows with the greatest weight of their group, ties kept, missing dropped.

    ``rank() = 1`` lets Spark prune each map-side partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(weight).desc())
    ranked = df.filter(F.col(weight).isNotNull()).withColumn("__r", F.rank().over(w))
    return ranked.filter("__r = 1").drop("__r")


def group_maximum(df: DataFrame, keys: Sequence[str], value: str, positive: bool = True) -> DataFrame:
    """All rows equal to their group's maximum (optionally only above zero)."""
    best = df.groupBy(*keys).agg(F.max(value).alias("__best"))
    if positive:
        best = best.filter("__best > 0")
    return natural_inner(df, best, keys).filter(F.col(value) == F.col("__best")).drop("__best")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of every key under a declared order, all columns kept.

    Written as ``min_by`` so the shuffle carries one candidate per key and task.
    """
    rest = [c for c in df.columns if c not in keys]
    o = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), o).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def tally(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def at_latest(df: DataFrame, period: str) -> DataFrame:
    """Rows of the latest period found anywhere in the table.

    The maximum is a one-row aggregate joined by hash on the period itself, which
    also works as a dynamic filter; no unpartitioned window is planned.
    """
    last = df.agg(F.max(period).alias(period))
    return df.join(F.broadcast(last), period, "left_semi")  # exactly one row


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_num") -> DataFrame:
    """Global 1-based row number under a total order, without a one-task sort.

    Rows are range-sorted and written once; numbering then needs only the row
    count of each sorted partition.
    """
    packed = cut_lineage(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__id"), 33).cast("int")
    counts = packed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition of the sort: bounded by the partition count.
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = packed.withColumn("__p", part).join(before, "__p")
    offset = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, (F.col("__before") + offset + 1).cast("bigint")).drop(
        "__p", "__id", "__before")


def group_index(df: DataFrame, keys: Sequence[str], name: str = "group_id",
                start_after: DataFrame | None = None) -> DataFrame:
    """Dense 1-based index of each distinct key in sort order.

    ``start_after`` is a one-row, one-column table whose value shifts the index.
    """
    index = number_rows(df.select(*keys).distinct(), list(keys), name)
    if start_after is not None:
        base = start_after.first()[0]  # one number
        index = index.withColumn(name, F.col(name) + F.lit(int(base or 0)))
    return natural_left(df, index, keys)


def order_levels(df: DataFrame, category: str, by: str, name: str = "ord") -> DataFrame:
    """Categories ranked by the median of another column (ties by name)."""
    from .ordered import exact_quantiles
    med = exact_quantiles(df, [category], by, [0.5]).select(category, F.col("quantile").alias("median_key"))
    return number_rows(med, ["median_key", category], name)


def clean_levels(df: DataFrame, keys: Sequence[str], first_order: str, label_col: str,
                 maxima: Sequence[str]) -> DataFrame:
    """Merge split records: first label by order, maximum of each measure."""
    return df.groupBy(*keys).agg(F.min_by(label_col, first_order).alias(label_col),
                                 *[F.max(m).alias(m) for m in maxima])
