"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node reachable; nodes without an edge are absent.

    Each round takes the least label among the neighbours and then the label of that label, so paths
    shrink geometrically.  A hot node meets one row per neighbour on one side and a single row on the
    other; its minimum is combined before the shuffle.  Tables are written each round, so a lost
    executor costs no earlier round.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = staged(one.union(one.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    table = labels
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")))
        least = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = staged(least.join(up, "label", "left").select(
            "node", "old", F.least("label", "up").alias("label")), "labels")
        settled = jumped.filter("label < old").isEmpty()
        discard(table)
        labels, table = jumped.select("node", "label"), jumped
        if settled:
            discard(both)
            return labels
