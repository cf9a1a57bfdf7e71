"""Exact order statistics without putting a whole group in one task.

A group can hold a third of the table, so no per-group sort or per-group value
map is used.  Values are cut into equal-depth blocks by sketched boundaries
(``approxQuantile`` brings back one number per block, and blocks hold about ``BLOCK_ROWS`` rows).
Block totals give each block's starting position; only then are distinct values
ordered, inside (group, block).  Copies of one value are one row by then, so the
largest window is about one block deep.  Boundaries affect balance only, never
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from .joins import natural_inner

BLOCK_ROWS = 250_000        # rows of a block at most, about; the number of blocks follows the table


def block_splits(df: DataFrame, values: Sequence[str], blocks: int | None = None) -> dict[str, list[float]]:
    """Equal-depth boundaries of several columns from one sketching pass.

    Without ``blocks`` the rows are counted first, so that a block stays bounded however large the table is.
    """
    blocks = blocks or 8 + df.count() // BLOCK_ROWS
    probs = [i / blocks for i in range(1, blocks)]
    cuts = df.select(*[F.col(v).cast("double").alias(v) for v in values]).approxQuantile(list(values), probs, 0.5 / blocks)
    return {v: [float("-inf"), *sorted(set(c)), float("inf")] for v, c in zip(values, cuts)}


def _blocked(df: DataFrame, value: str, splits: list[float]) -> DataFrame:
    cut = Bucketizer(splits=splits, inputCol="__place", outputCol="__blk", handleInvalid="keep")
    placed = cut.transform(df.withColumn("__place", F.col(value).cast("double")))
    return placed.withColumn("__blk", F.col("__blk").cast("int")).drop("__place")


def _present(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Rows with a value, in its own type: only the block index is a double, which never reorders values."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, value, *extra)


def running_totals(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str],
                   blocks: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """Running sums of measures by increasing value within each key.

    Returns one row per (key, value) with ``<m>``, ``<m>_before`` and ``<m>_total``.
    """
    rows = _present(df, keys, value, measures)
    splits = splits or block_splits(rows, [value], blocks)[value]
    per_value = rows.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    per_value = _blocked(per_value, value, splits)
    # Block totals come from the distinct values, so both uses share one exchange.
    totals = _block_offsets(per_value.groupBy(*keys, "__blk").agg(*[F.sum(m).alias(m) for m in measures]), keys, measures)
    w = (Window.partitionBy(*keys, "__blk").orderBy(value)
         .rowsBetween(Window.unboundedPreceding, -1))
    inner = per_value.withColumns({f"__in_{m}": F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures})
    out = natural_inner(inner, totals, [*keys, "__blk"])
    return out.select(*keys, value, *measures,
                      *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(f"{m}_before") for m in measures],
                      *[F.col(f"{m}_total") for m in measures])


def _block_offsets(totals: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Start of every block; a key has at most one row per block here."""
    w = Window.partitionBy(*keys).orderBy("__blk")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    return totals.select(*keys, "__blk",
                         *[F.coalesce(F.sum(m).over(prev), F.lit(0)).alias(f"__off_{m}") for m in measures],
                         *[F.sum(m).over(everything).alias(f"{m}_total") for m in measures])


def tie_ranks(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None,
              splits: list[float] | None = None) -> DataFrame:
    """Tie-averaged rank of each distinct value within its key: ``keys, value, rank_<value>``."""
    counted = running_totals(df.withColumn("__n", F.lit(1).cast("bigint")), keys, value, ["__n"], blocks, splits)
    return counted.select(*keys, value, (F.col("__n_before") + (F.col("__n") + 1) / 2.0).alias(f"rank_{value}"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    blocks: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """Exact interpolated quantiles: ``keys, prob, quantile``.

    Scan 1 sketches boundaries, scan 2 counts blocks (a tiny shuffle), scan 3
    orders only the one or two blocks that hold each requested rank.
    """
    rows = _present(df, keys, value)
    splits = splits or block_splits(rows, [value], blocks)[value]
    if not keys:
        rows, keys_in = rows.withColumn("__g", F.lit(1)), ["__g"]
    else:
        keys_in = list(keys)
    blk = _blocked(rows, value, splits)
    counts = blk.groupBy(*keys_in, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    # At most ``blocks`` rows per key from here to ``want``.
    w = Window.partitionBy(*keys_in).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    place = counts.withColumns({"__off": F.coalesce(F.sum("__n").over(w), F.lit(0)),
                                "__all": F.sum("__n").over(Window.partitionBy(*keys_in))})
    want = place.withColumn("__p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    want = want.withColumn("__h", (F.col("__all") - 1) * F.col("__p")).withColumn(
        "__rank", F.explode(F.array_distinct(F.array(F.floor("__h").cast("bigint"), F.ceil("__h").cast("bigint")))))
    want = want.filter((F.col("__rank") >= F.col("__off")) & (F.col("__rank") < F.col("__off") + F.col("__n")))
    want = want.select(*keys_in, "__blk", "__p", "__h", "__rank", "__off")
    targets = want.select(*keys_in, "__blk").distinct()
    inside = natural_inner(blk, targets, [*keys_in, "__blk"]).groupBy(*keys_in, "__blk", value).agg(
        F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys_in, "__blk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__lo", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    start = F.col("__off") + F.col("__lo")
    hit = natural_inner(want, inside, [*keys_in, "__blk"]).filter(
        (F.col("__rank") >= start) & (F.col("__rank") < start + F.col("__n")))
    # One or two rows per (key, prob): the neighbours of the fractional rank.
    lo, hi = F.min(value), F.max(value)
    frac = F.first("__h") - F.floor(F.first("__h"))
    out = hit.groupBy(*keys_in, "__p").agg((lo + (hi - lo) * frac).alias("quantile"))
    return out.select(*keys, F.col("__p").alias("prob"), "quantile")


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float],
                     blocks: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """Exact quantiles as one column per name."""
    q = exact_quantiles(df, keys, value, list(named.values()), blocks, splits)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
                                  for n, p in named.items()])
