"""Descriptive tables: predictor summaries, histograms, box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.missing import std_error
from .joins import natural_inner, natural_left
from .ordered import block_splits, quantile_columns


def predictor_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, standard error, range and count of each column's recorded values."""
    of = lambda c: F.col(f"`{c}`").cast("double")
    row = df.agg(*[F.struct(F.lit(c).alias("variable"), F.avg(of(c)).alias("value_mean"), std_error(of(c)).alias("value_se"),
                            F.min(of(c)).alias("value_min"), F.max(of(c)).alias("value_max"), F.count(of(c)).alias("value_n"))
                   .alias(f"s{i}") for i, c in enumerate(cols)])
    return row.select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("s.*").filter("value_n > 0")


def median_and_se(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median and standard error of columns by group; one sketch serves all columns."""
    out = df.groupBy(*keys).agg(*[std_error(c).alias(f"{c}_se") for c in cols])
    splits = block_splits(df, cols)
    for c in cols:
        out = natural_left(out, quantile_columns(df, keys, c, {f"{c}_med": 0.5}, splits=splits[c]), keys)
    return out


def histogram(df: DataFrame, facet: Sequence[str], value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts by facet.

    Bin centres run from the facet's minimum to its maximum; half a bin hangs
    over at each end.
    """
    rows = df.filter(F.col(value).isNotNull())
    span = rows.groupBy(*facet).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = span.withColumn("width", (F.col("__hi") - F.col("__lo")) / F.lit(float(bins - 1)))
    placed = natural_inner(rows, span, facet)
    pos = F.floor(F.try_divide(F.col(value) - F.col("__lo"), F.col("width")) + 0.5)
    placed = placed.withColumn("bin", F.coalesce(pos, F.lit(0)).cast("int"))
    return placed.groupBy(*facet, *by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("__lo") + F.col("bin") * F.col("width")).alias("center"))


def log_histogram(df: DataFrame, facet: Sequence[str], value: str, width: float = 0.2) -> DataFrame:
    """Counts in log10 bins of fixed width; only positive values have a place."""
    pos = df.filter(F.col(value) > 0)
    b = F.floor(F.log10(value) / F.lit(width) + 0.5).cast("int")
    out = pos.groupBy(*facet, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("center", F.col("bin") * F.lit(width))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within ``reach`` IQR, outlier count."""
    q = quantile_columns(df, keys, value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    rows = natural_inner(df.filter(F.col(value).isNotNull()), q, keys)
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    inside = (v >= F.col("q1") - F.lit(reach) * iqr) & (v <= F.col("q3") + F.lit(reach) * iqr)
    return rows.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("med").alias("med"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"),
        F.count_if(~inside).alias("n_out"))


def box_outliers(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows beyond the whiskers of their group."""
    q = quantile_columns(df, keys, value, {"__q1": 0.25, "__q3": 0.75})
    rows = natural_inner(df.filter(F.col(value).isNotNull()), q, keys)
    span = F.lit(reach) * (F.col("__q3") - F.col("__q1"))
    beyond = (F.col(value) < F.col("__q1") - span) | (F.col(value) > F.col("__q3") + span)
    return rows.filter(beyond).drop("__q1", "__q3")


def z_scores(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Centre and scale columns by their sample sd (one aggregate, one row)."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols],
                   *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]).first()
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - lit(stats[f"__m_{c}"]), lit(stats[f"__s_{c}"]))
                           for c in cols})
