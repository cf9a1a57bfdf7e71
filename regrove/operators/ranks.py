"""Tie-averaged ranks of many columns in two exchanges.

All columns are melted to (variable, value, row) and range-sorted once; a value's or a group's rows may fill any number
of sorted partitions, as the row is the last sort key.  Each partition numbers its own rows as a stream and reports only its first and
last group and tied value, and those tied over more rows than are held at a time.  From these few numbers per partition follow the
offsets, and the ranks of values tied across partitions.  One more shuffle brings the ranks back beside their row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..session import staged

ROW = "__row"
INSIDE, FIRST_GROUP, FIRST_TIE, LAST_TIE, LONG_TIE = range(5)        # a partition's long ties have a zone each, from LONG_TIE up
PART_ROWS = 4_000_000   # melted rows of a partition, about
HELD = 1 << 16          # rows of an open tie that are held until its size is known
_MELTED = f"{ROW} long, var int, part int, zone int, place double, g long, v long, in_group long, in_tie long"


def numbered_rows(df: DataFrame, label: str = "rows") -> DataFrame:
    """The rows, written once, with a row number ``__row`` that never changes again."""
    return staged(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def _melted(base: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, var, i, f, d, row) of every present value; each kind of number has a column of its own, so none loses digits."""
    types = {f.name: f.dataType for f in base.schema.fields}
    scale = max([types[c].scale for c in cols if isinstance(types[c], DecimalType)], default=0)
    entries = []
    for n, c in enumerate(cols):
        float_like, decimal = isinstance(types[c], (DoubleType, FloatType)), isinstance(types[c], DecimalType)
        value = F.col(f"`{c}`")
        number = value.cast("double") + F.lit(0.0)      # one zero only
        entries.append(F.struct(F.lit(n).alias("var"), (F.lit(None) if float_like or decimal else value).cast("long").alias("i"),
                                (F.when(~F.isnan(number), number) if float_like else F.lit(None)).cast("double").alias("f"),
                                (value if decimal else F.lit(None)).cast(f"decimal(38,{scale})").alias("d")))
    named = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)]
    rows = base.select(*named, ROW, F.explode(F.array(*entries)).alias("e"))
    return rows.select(*[f"__k{n}" for n in range(len(keys))], "e.*", ROW).filter("i is not null or f is not null or d is not null")


def rank_columns(base: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``__row`` and ``rank_<col>`` for each of ``cols`` within ``keys`` of ``numbered_rows``; rows without any value are absent."""
    melted = _melted(base, keys, cols)
    group = [f"__k{n}" for n in range(len(keys))] + ["var"]
    order = [*group, "i", "f", "d", ROW]
    spark = base.sparkSession
    parts = base.count() * len(cols) // PART_ROWS       # more than the session's where that leaves too many rows to one
    dealt = melted.repartitionByRange(parts, *order) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else melted.repartitionByRange(*order)
    sorted_rows = dealt.sortWithinPartitions(*order)
    slim = sorted_rows.select(ROW, "var", F.xxhash64(*group).alias("g"), F.xxhash64("i", "f", "d").alias("v"))
    placed = staged(slim.mapInArrow(_number, _MELTED), "placed")
    # Two rows per partition, and one for each tie of more than HELD rows.
    ends = placed.filter("g is not null").orderBy("part", "zone").select("part", "zone", "g", "v", "in_group", "in_tie", "place").collect()
    shifts = partition_shifts([tuple(r)[:6] for r in ends if r["zone"] < LONG_TIE])
    shift, last = {p: s for p, s, _, _ in shifts}, {p: b for p, _, _, b in shifts}
    added = [(p, zone, v) for p, s, a, b in shifts for zone, v in ((FIRST_GROUP, s), (FIRST_TIE, a), (LAST_TIE, b))]
    for r in ends:
        if r["zone"] >= LONG_TIE:
            part, within = r["part"], r["g"]
            added.append((part, r["zone"], last[part] if within == LAST_TIE else r["place"] + (shift[part] if within == FIRST_GROUP else 0.0)))
    table = spark.createDataFrame(added, "part int, zone int, added double")
    found = placed.filter("g is null").join(F.broadcast(table), ["part", "zone"], "left")
    rank = F.when(F.col("zone") == INSIDE, F.col("place")).when(F.col("zone") == FIRST_GROUP, F.col("place") + F.col("added")).otherwise(F.col("added"))
    return found.groupBy(ROW).agg(*[F.max(F.when(F.col("var") == n, rank)).alias(f"rank_{c}") for n, c in enumerate(cols)])


_NAMES = [ROW, "var", "part", "zone", "place", "g", "v", "in_group", "in_tie"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks inside one sorted partition, then a row each for its first and its last group and tie, and for each long tie.

    Batches are cut into ties; the last tie of a batch is held back until the next one tells whether it goes on.  Of a tie that
    fills more than ``HELD`` rows all but one go out under a zone of their own, whose rank follows when the tie has ended.
    """
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    held: list[tuple[np.ndarray, np.ndarray]] = []      # rows and variables of the open tie
    tie, start = None, 0                                # its group and value, its first place in the group
    gone, kept = 0, 0                                   # its rows that went out before, and those held
    groups, done = 0, 0                                 # groups begun, ties written
    first, first_group = None, None                     # first tie: group, value, rows; rows of the first group
    long: list[tuple[int, float]] = []                  # long ties: where they lie, rank in the partition

    def written(rows, var, zone, place):
        n = len(rows)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(var, pa.int32()), pa.array(np.full(n, part), pa.int32()),
                                           pa.array(zone, pa.int32()), pa.array(place, pa.float64()), none, none, none, none], _NAMES)

    def own_zone():
        """Zone of the open tie's rows that go out before it has ended."""
        return LONG_TIE + len(long) if done else FIRST_TIE

    for batch in batches:
        rows, var, g, v = (batch.column(c).to_numpy() for c in (ROW, "var", "g", "v"))
        if not len(rows):
            continue
        if tie and g[-1] == tie[0] and v[-1] == tie[1] and g[0] == tie[0] and v[0] == tie[1]:
            held.append((rows, var))        # sorted, so all of the batch belongs to the open tie
            kept += len(rows)
        else:
            if tie:
                rows, var = (np.concatenate([*x, y]) for x, y in zip(zip(*held), (rows, var)))
                g, v = (np.concatenate([np.full(kept, t), x]) for t, x in zip(tie, (g, v)))
            starts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
            here = np.diff(np.append(starts, len(rows)))
            sizes = here.copy()
            sizes[0] += gone
            fresh = np.append(tie is None, g[starts[1:]] != g[starts[:-1]])
            origin = np.maximum.accumulate(np.where(fresh, starts, -1))
            place = np.where(origin >= 0, starts - origin, starts + start)
            place[1:] += np.where(origin[1:] >= 0, 0, gone)
            number = groups + np.cumsum(fresh)
            if first_group is None and number[-1] > 1:
                last_of_first = int(np.flatnonzero(number == 1)[-1])
                first_group = int(place[last_of_first] + sizes[last_of_first])
            k = len(starts) - 1
            if k and first is None:
                first = (int(g[0]), int(v[0]), int(sizes[0]))
            if k:
                at = np.repeat(np.arange(k), here[:k])
                zone, rank = np.where(number[:k] == 1, FIRST_GROUP, INSIDE), place[:k] + (sizes[:k] + 1) / 2.0
                if done == 0:
                    zone[0] = FIRST_TIE
                elif gone:
                    within, zone[0] = int(zone[0]), own_zone()
                    long.append((within, float(rank[0])))
                yield written(rows[:starts[k]], var[:starts[k]], zone[at], rank[at])
                gone = 0
            held, kept = [(rows[starts[k]:], var[starts[k]:])], int(here[k])
            tie, start, groups, done = (g[-1], v[-1]), int(place[k]), int(number[k]), done + k
        if kept > HELD:
            rows, var = (np.concatenate(x) for x in zip(*held))
            yield written(rows[:-1], var[:-1], np.full(kept - 1, own_zone()), np.zeros(kept - 1))
            held, gone, kept = [(rows[-1:], var[-1:])], gone + kept - 1, 1
    if tie is None:
        return
    rows, var = (np.concatenate(x) for x in zip(*held))
    n = gone + kept
    last = (int(tie[0]), int(tie[1]), n)
    yield written(rows, var, np.full(kept, LAST_TIE if done else FIRST_TIE), np.full(kept, start + (n + 1) / 2.0))
    if done and gone:
        long.append((LAST_TIE, 0.0))
    ends = [(FIRST_TIE, first or last, start + n if first_group is None else first_group), (LAST_TIE, last, start + n)]
    m = len(long)
    yield pa.RecordBatch.from_arrays([
        pa.nulls(2 + m, pa.int64()), pa.nulls(2 + m, pa.int32()), pa.array([part] * (2 + m), pa.int32()),
        pa.array([z for z, _, _ in ends] + [LONG_TIE + i for i in range(m)], pa.int32()), pa.array([None, None, *(r for _, r in long)], pa.float64()),
        *[pa.array(c + d, pa.int64()) for c, d in (([t[0] for _, t, _ in ends], [w for w, _ in long]), ([t[1] for _, t, _ in ends], [None] * m),
                                                   ([n for _, _, n in ends], [None] * m), ([t[2] for _, t, _ in ends], [None] * m))]], _NAMES)


def partition_shifts(ends: list[tuple]) -> list[tuple]:
    """(part, shift of its first group, rank of its first tie, rank of its last tie), from the two end rows of every partition, in order.

    An end row is (part, zone, group, value, rows of the group in the partition, rows of the tie in the partition).
    """
    out, chains = [], []        # a chain: start of a tied value in its group, rows of it
    group, before, chain_key = None, 0, None
    for first, last in zip(ends[::2], ends[1::2]):
        shift = before if first[2] == group else 0
        if chain_key == first[2:4]:
            chains[-1][1] += first[5]
        else:
            chains.append([shift, first[5]])
        at_first = len(chains) - 1
        one_group = first[2] == last[2]
        own = shift if one_group else 0
        if first[2:4] != last[2:4]:
            chains.append([own + last[4] - last[5], last[5]])
        out.append((first[0], float(shift), at_first, len(chains) - 1))
        group, before, chain_key = last[2], own + last[4], last[2:4]
    rank = [start + (n + 1) / 2.0 for start, n in chains]
    return [(p, s, rank[a], rank[b]) for p, s, a, b in out]
