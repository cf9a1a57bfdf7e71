"""Running totals of huge groups, without one task that holds a group.

Rows are range-sorted by (group, order) and written once, so a group of any size is spread over as many
sorted partitions as it fills.  Totals run inside (partition, group); a group that goes on from an earlier partition is
shifted by what it has there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged


def range_sorted(df: DataFrame, order: Sequence[str], keep: Sequence[str | Column], label: str = "sorted") -> DataFrame:
    """``keep`` of the rows sorted by ``order``, with ``__part`` and the place ``__at`` in that partition.

    Rows equal in ``order`` are told apart by their place in ``df``, which must be read from files, so that a
    table of equal rows is spread as well.  Nulls come first.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    packed = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
    place = F.monotonically_increasing_id()
    rows = packed.select(*keep, place.alias("__id"))
    low = F.lit((1 << 33) - 1)
    return staged(rows.select(*[c for c in rows.columns if c != "__id"], F.shiftright("__id", 33).cast("int").alias("__part"),
                              F.col("__id").bitwiseAND(low).alias("__at")), label)


def total_before(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """``range_sorted`` rows with the total of ``value`` (long, no nulls) over the rows before them in their group."""
    inside = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    totals = rows.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (totals.withColumn("__shift", F.sum("__sum").over(earlier)).filter("__shift is not null")
             .select(F.col("__part").alias("__p"), "__shift", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    # Only the first group of a partition can go on from an earlier one: one row per partition at most.
    moved = out.join(F.broadcast(shift), same, "left")
    return moved.withColumn(name, F.col("__in") + F.coalesce("__shift", F.lit(0).cast("long"))).select(*rows.columns, name)
