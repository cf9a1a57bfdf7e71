"""Sharding over fixed virtual slots.

Records hash into thousands of slots; only the slot-to-shard map, a table of one row per slot and
version, decides where a slot lives.  Rebalancing edits the map by the bytes of each slot and
appends the edits as a new version, so records never have to be hashed again.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import staged

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int"
ADDED = ("shard", "slot", "virtual_slot")       # columns that sharding gives


def slot_of(*keys: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot: str, size: str, slots: int = SLOTS) -> np.ndarray:
    """Bytes per slot: a pre-aggregated table of at most ``slots`` rows, so it fits the driver."""
    out = np.zeros(slots, np.int64)
    for r in records.groupBy(slot).agg(F.sum(size).alias("b")).collect():
        out[r[0]] = r["b"] or 0
    return out


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots) % shards


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """Edit a map until no move or exchange between the fullest and the emptiest shard helps.

    Each step shifts the amount nearest to half of their difference: a slot alone, or a slot
    against a smaller one.  Works for a grown shard count as well: new shards start empty.
    """
    owner = owner.copy()
    load = np.bincount(owner, weights=weight, minlength=shards).astype(np.int64)
    held = [sorted((int(weight[i]), int(i)) for i in np.flatnonzero((owner == s) & (weight > 0))) for s in range(shards)]
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        best = (gap, None, None)
        small = [(0, -1), *held[low]]
        for w, i in held[high]:
            k = bisect.bisect_left(small, (w - gap / 2, -1))
            for v, j in small[max(0, k - 1):k + 1]:
                rest = abs(gap - 2 * (w - v))
                if 0 < w - v < gap and rest < best[0]:
                    best = (rest, (w, i), (v, j))
        if best[1] is None:
            return owner
        (w, i), (v, j) = best[1], best[2]
        held[high].remove((w, i))
        bisect.insort(held[low], (w, i))
        owner[i] = low
        if j >= 0:
            held[low].remove((v, j))
            bisect.insort(held[high], (v, j))
            owner[j] = high
        load[high] -= w - v
        load[low] += w - v


def map_table(spark: SparkSession, versions: list[np.ndarray]) -> DataFrame:
    """The stored map: (version, slot, shard), later versions holding only the edited slots."""
    rows, old = [], None
    for n, owner in enumerate(versions, 1):
        changed = range(len(owner)) if old is None else np.flatnonzero(owner != old)
        rows += [(n, int(s), int(owner[s])) for s in changed]
        old = owner
    return staged(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1), "slot-map")


def owners(table: DataFrame, version: int) -> DataFrame:
    """Slot and shard as of a version: the last edit of each slot up to it."""
    return (table.filter(F.col("version") <= version).groupBy(F.col("slot").alias("__slot"))
            .agg(F.max_by("shard", "version").alias("shard")))


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a map that ``save_version`` wrote."""
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def latest(table: DataFrame, slots: int = SLOTS) -> tuple[int, np.ndarray]:
    """Number and owners of the newest version: at most ``slots`` rows reach the driver."""
    version = table.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError("the map has no version")
    owner = np.full(slots, -1)
    for r in owners(table, version).collect():
        owner[r["__slot"]] = r["shard"]
    if (owner < 0).any():
        raise ValueError(f"the map does not cover {slots} slots")
    return version, owner


def save_version(spark: SparkSession, path: str, owner: np.ndarray, version: int = 1, old: np.ndarray | None = None) -> None:
    """Append one version to the map at ``path``: all slots, or those that differ from ``old``.

    A version without edits writes nothing, so the newest one stays what it was.
    """
    changed = np.arange(len(owner)) if old is None else np.flatnonzero(owner != old)
    rows = [(version, int(s), int(owner[s])) for s in changed]
    if rows:
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rebalance_stored(spark: SparkSession, path: str, weight: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """Load the newest version, edit it for the present bytes of its slots, and append the edits."""
    version, old = latest(load_map(spark, path), len(weight))
    if old.max() >= shards:
        raise ValueError("the map has more shards; slots of a shard that goes must be moved first")
    owner = rebalance(old, weight, shards)
    if (owner == old).all():
        return version, old
    save_version(spark, path, owner, version + 1, old)
    return version + 1, owner


def shard_records(records: DataFrame, key: tuple[str, ...], size: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Records with ``shard`` and ``slot``, their gapless place in the shard (from 0).

    Shards hold near equal sums of ``size``.  Rows are numbered inside their virtual slot, which holds
    about one in ``slots`` rows, and shifted by the rows of the shard's earlier slots, so no task sees a
    whole shard.  Equal rows hash alike and share a slot; their order among each other is arbitrary.
    Null keys hash like any value, and a null size weighs nothing.  Columns of the records that are named like
    one of ``ADDED`` are left out, unless they are keys or the size, for which such names are refused.
    No row gives an empty result.
    """
    spark = records.sparkSession
    taken = {c.lower() for c in ADDED} & {c.lower() for c in (*key, size)}
    if taken:
        raise ValueError(f"rename {sorted(taken)}: sharding gives columns of these names")
    records = records.drop(*[c for c in records.columns if c.lower() in ADDED])
    keyed = staged(records.withColumn("__slot", slot_of(*key, slots=slots)), "slotted")
    weight = slot_bytes(keyed, "__slot", size, slots)
    start = first_map(slots, shards)
    table = map_table(spark, [start, rebalance(start, weight, shards)])
    owned = owners(table, 2)
    counts = keyed.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"))
    # At most one row per slot: a table of fixed size, which also makes the broadcast below safe.
    before = (owned.join(counts, "__slot")
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__slot")) - F.col("__n"))
              .select("__slot", "shard", "__before"))
    place = F.row_number().over(Window.partitionBy("__slot").orderBy(*[F.col(k) for k in key]))
    return (keyed.withColumn("__place", place - 1).join(F.broadcast(before), "__slot")
            .withColumn("slot", (F.col("__before") + F.col("__place")).cast("long"))
            .drop("__before", "__place").withColumnRenamed("__slot", "virtual_slot"))
