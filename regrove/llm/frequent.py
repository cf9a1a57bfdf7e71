"""The most frequent keys of a count table, without one task that merges a share of every partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def most_frequent(counts: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    """At most ``limit`` rows with the greatest counts, ties by key.

    A table with more rows is first cut at the quantile that leaves ``limit`` of them; rows at the cut
    itself are left out, so that few more rows than ``limit`` are ever sorted.
    """
    n = counts.count()
    if n > limit:
        cut = counts.agg(F.percentile_approx(count, 1.0 - limit / n, 1_000_000)).first()[0]
        counts = counts.filter(F.col(count) > cut)
    return counts.orderBy(F.desc(count), key).limit(limit)
