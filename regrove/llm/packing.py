"""Packing into optimal length buckets.

Documents longer than the model window are cut into pieces of the window, so lengths lie in
1 .. window and the global histogram has at most ``window`` rows.  Dynamic programming over that
histogram chooses the bucket boundaries of least total padding.  Inside a bucket, pieces in
hashed order fill batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

WORD_CUT = r"[\x20\x09-\x0D]+"


def token_length(text: str = "text") -> Column:
    """Words of a text plus one end token; a null text has the end token only."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_CUT, " "))
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return (F.when(t == "", 1).otherwise(spaces + 2)).cast("long")


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total of count * (bound - length).

    best[k][j] is the least padding of the j smallest lengths in k buckets.  The last split moves
    right with j, so each row is solved by halving: O(buckets * n * log n) for n lengths.
    """
    n = len(lengths)
    if n == 0:
        return []
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(c)]).astype(object if float(x[-1]) * float(c.sum()) > 2.0**62 else np.int64)
    tokens = np.concatenate([[0], np.cumsum(c.astype(rows.dtype) * x)])

    def cost(i, j):     # lengths i .. j-1 padded to the largest of them
        return x[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    buckets = min(buckets, n)
    best = np.array([0] + [cost(0, j) for j in range(1, n + 1)], rows.dtype)
    splits = [np.zeros(n + 1, np.int64)]
    for k in range(2, buckets + 1):
        row, at = best.copy(), np.zeros(n + 1, np.int64)
        stack = [(k, n, k - 1, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + cost(i, j)
            m = int(np.argmin(total))
            row[j], at[j] = total[m], i[m]
            stack += [(lo, j - 1, left, int(i[m])), (j + 1, hi, int(i[m]), right)]
        best = row
        splits.append(at)
    bounds, j = [], n
    for at in reversed(splits):
        bounds.append(int(x[j - 1]))
        j = int(at[j])
        if j == 0:
            break
    return sorted(bounds)


def pack(docs: DataFrame, length: Column, key: tuple[str, ...] = ("doc_id",), buckets: int = 16, window: int = 4096,
         budget: int = 65536, text: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts, its length, bucket, padded length and batch.

    ``length`` (1 at least) is cut into pieces of ``window``.  ``bucket`` counts boundaries from 0;
    ``padded`` is the boundary; a batch of a bucket holds as many pieces as fit ``budget`` after padding
    (one at least), numbered from 0 in each bucket; only the last batch of a bucket may be short.
    Null keys and repeated rows are packed like others; other columns are not read.  An empty table
    gives no rows.

    Pieces are dealt into blocks by hash; they are numbered inside (bucket, block) and shifted by the
    block counts, so a bucket with most of all pieces is never in one task.
    """
    spark = docs.sparkSession
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("__length") - 1) / window).cast("int")))
    base = docs.select(*key, length.alias("__length"), F.xxhash64(*key, F.col(text)).alias("__hash"))
    pieces = (base.withColumn("piece", cut)
              .withColumn("start", F.col("piece").cast("long") * window)
              .withColumn("length", F.least(F.col("__length") - F.col("start"), F.lit(window)).cast("int"))
              .drop("__length"))
    pieces = staged(pieces, "pieces")
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()   # at most ``window`` rows
    bounds = optimal_buckets(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    blocks = 1 + sum(r[1] for r in histogram) // 200_000
    edge = F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        edge = F.when(F.col("length") <= bounds[i], F.lit(i)).otherwise(edge)
    padded = F.element_at(F.array(*[F.lit(b) for b in bounds or [1]]), F.col("bucket") + 1)
    dealt = (pieces.withColumn("bucket", edge).withColumn("padded", padded)
             .withColumn("__block", F.pmod(F.xxhash64("__hash", "piece"), F.lit(blocks)).cast("int")))
    counts = dealt.groupBy("bucket", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("bucket").orderBy("__block"))
                               - F.col("__n")).drop("__n")   # one row per bucket and block
    inside = F.row_number().over(Window.partitionBy("bucket", "__block").orderBy("__hash", "piece")) - 1
    numbered = dealt.withColumn("__place", inside).join(before, ["bucket", "__block"])
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1))
    return (numbered.withColumn("batch", F.floor((F.col("__before") + F.col("__place")) / room).cast("long"))
            .select(*key, "piece", "start", "length", "bucket", "padded", "batch"))
