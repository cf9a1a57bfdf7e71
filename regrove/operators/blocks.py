"""Pairs of locations met block by block, for statistics of all distances.

Locations are sorted along a curve that fills their square and cut into blocks of about as many each, so a dense spot
makes small blocks and no large one.  A block is one row; pairs of blocks are named on the driver from one row of limits
per block, and a task holds two blocks at a time.  There a block is cut into chunks, a pair of chunks is settled from
its limits and sums where they suffice, and only the locations of other pairs of chunks are met, in arrays of fixed size.
Nothing is written per pair of chunks or locations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settings, staged

LEAST = 2048            # locations of a block, unless there are fewer
TASK_PAIRS = 2e8        # pairs of locations that one task may have to meet, about
CELLS, PIECE = 1 << 16, 1 << 14     # pairs of chunks, of locations looked at in one array
BATCH = 1 << 24         # bytes of blocks in an Arrow batch, about
_BOX = ("xlo", "xhi", "ylo", "yhi")
_MOMENTS = ("gx", "gy", "mxx", "mxy", "myy", "mxxx", "mxxy", "mxyy", "myyy")


def block_size(n: int) -> int:
    """Blocks and what is copied to meet them stay few: some sqrt(n) / 12 blocks."""
    return max(LEAST, int(12 * math.sqrt(n)))


def _spread(c: Column) -> Column:
    """Bits 0 to 23 of a number at every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def packed(locs: DataFrame, i: Column, j: Column, cols: list[str], n: int) -> DataFrame:
    """One row per block: its number, the summaries of ``cols`` (x, y, n first) and its locations as bytes; i, j are cells."""
    size = block_size(n)
    curve = _spread(i.cast("long")).bitwiseOR(F.shiftleft(_spread(j.cast("long")), 1))
    rows = locs.select(curve.alias("z"), *cols).repartitionByRange(max(1, n // (8 * size)), "z").sortWithinPartitions("z").select(*cols)
    names = _summary_names(len(cols))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held, count, block = [], 0, TaskContext.get().partitionId() << 32

        def written(p):
            data = {k: pa.array(v) for k, v in summaries(p, np.array([0])).items()}
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), **data, "data": pa.array([p.tobytes()], pa.binary())})

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]))
            count += batch.num_rows
            if count >= size:
                p = np.concatenate(held, axis=1)
                while p.shape[1] >= size:
                    yield written(p[:, :size])
                    p, block = p[:, size:], block + 1
                held, count = [p], p.shape[1]
        if count:
            yield written(np.concatenate(held, axis=1))

    return staged(rows.mapInArrow(pack, "block long, " + ", ".join(f"{c} double" for c in names) + ", data binary"), "blocks")


def limits(blocks: DataFrame) -> dict[str, np.ndarray]:
    """Numbers and summaries of the blocks: one row per block, of which there are few."""
    rows = blocks.drop("data").orderBy("block").collect()
    return {c: np.array([r[c] for r in rows]) for c in blocks.columns if c != "data"}


def _summary_names(cols: int) -> list[str]:
    return ["k", "n", *_BOX, *(["s", "ss", *_MOMENTS] if cols > 3 else [])]


def summaries(p: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Of each run of locations: their number, copies, box and, if they carry a value, its sums and the moments about the centre of mass."""
    x, y, n = p[:3]
    add = lambda v: np.add.reduceat(v, starts)
    k = np.diff(np.append(starts, len(x)))
    out = {"k": k.astype(float), "n": add(n), "xlo": np.minimum.reduceat(x, starts), "xhi": np.maximum.reduceat(x, starts),
           "ylo": np.minimum.reduceat(y, starts), "yhi": np.maximum.reduceat(y, starts)}
    if len(p) > 3:
        # From a corner of the box, so that a small run far from zero keeps its digits.
        gx, gy = (low + add(n * (v - np.repeat(low, k))) / out["n"] for v, low in ((x, out["xlo"]), (y, out["ylo"])))
        u, v = x - np.repeat(gx, k), y - np.repeat(gy, k)
        nu, nv = n * u, n * v
        out |= {"s": add(p[3]), "ss": add(p[4]), "gx": gx, "gy": gy, "mxx": add(nu * u), "mxy": add(nu * v), "myy": add(nv * v),
                "mxxx": add(nu * u * u), "mxxy": add(nu * u * v), "mxyy": add(nu * v * v), "myyy": add(nv * v * v)}
    return out


class Chunks:
    """Locations of a block (rows x, y, n and more), sorted so that each run of ``size`` of them lies close together."""

    def __init__(self, p: np.ndarray, size: int):
        n = p.shape[1]
        x, y = p[:2]
        chunks = -(-n // size)
        wide, high = max(float(np.ptp(x)), 1e-300), max(float(np.ptp(y)), 1e-300)
        strips = int(min(max(round(math.sqrt(chunks) * math.sqrt(wide) / math.sqrt(high)), 1), chunks))
        place = np.empty(n, np.int64)
        place[np.argsort(x, kind="stable")] = np.arange(n)
        self.p = p[:, np.lexsort((y, place // (-(-chunks // strips) * size)))]
        self.size, self.n = size, n
        self.sums = summaries(self.p, np.arange(0, n, size))
        self.single = bool((self.p[2] == 1).all())

    def __len__(self) -> int:
        return len(self.sums["k"])

    def at(self, chunk: int) -> slice:
        return slice(chunk * self.size, min(self.n, (chunk + 1) * self.size))

    def rows(self, chunks: np.ndarray) -> np.ndarray:
        r = (chunks[:, None] * self.size + np.arange(self.size)).ravel()
        return r[:np.searchsorted(r, self.n)]


def reach(a: dict[str, np.ndarray], i, b: dict[str, np.ndarray], j) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of the boxes ``i`` of a and ``j`` of b, with a hair of slack."""
    nx = np.maximum(np.maximum(b["xlo"][j] - a["xhi"][i], a["xlo"][i] - b["xhi"][j]), 0)
    ny = np.maximum(np.maximum(b["ylo"][j] - a["yhi"][i], a["ylo"][i] - b["yhi"][j]), 0)
    fx = np.maximum(b["xhi"][j] - a["xlo"][i], a["xhi"][i] - b["xlo"][j])
    fy = np.maximum(b["yhi"][j] - a["ylo"][i], a["yhi"][i] - b["ylo"][j])
    return np.hypot(nx, ny) * (1 - 1e-12), np.hypot(fx, fy) * (1 + 1e-12)


def slabs(a: Chunks, b: Chunks, own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first chunk of a, near, far, unordered pair or not) for some chunks of a against all of b at a time."""
    step = max(1, CELLS // len(b))
    every = np.arange(len(b))
    for lo in range(0, len(a), step):
        i = np.arange(lo, min(len(a), lo + step))[:, None]
        near, far = reach(a.sums, i, b.sums, every[None, :])
        yield lo, near, far, (every >= i) if own else np.ones(near.shape, bool)


class Distances:
    """Distances between the locations of a chunk and others, in arrays that are used again."""

    def __init__(self, a: Chunks, b: Chunks):
        self.a, self.b = a, b
        self.piece = max(1, PIECE // a.size)
        self.room = [np.empty(a.size * self.piece) for _ in range(2)] + [np.empty(a.size * self.piece, np.int64)]

    def met(self, chunk: int, others: np.ndarray, own: bool) -> Iterator[tuple]:
        """(rows of a, rows of b, distances, spare array, spare whole numbers) of a chunk and other chunks; with itself, each pair once."""
        at = self.a.at(chunk)
        if own and len(others) and others[0] == chunk:
            i, j = np.triu_indices(at.stop - at.start, 1)
            if len(i):
                i, j = i + at.start, j + at.start
                x, y = self.a.p[:2]
                yield i, j, _length(x[i] - x[j], y[i] - y[j]), np.empty(len(i)), np.empty(len(i), np.int64)
            others = others[1:]
        if not len(others):
            return
        rows = self.b.rows(others)
        i = np.arange(at.start, at.stop)[:, None]
        for lo in range(0, len(rows), self.piece):
            j = rows[lo:lo + self.piece]
            d, t, whole = (r[:i.size * len(j)].reshape(i.size, len(j)) for r in self.room)
            np.subtract(self.a.p[0][i], self.b.p[0][j], out=d)
            np.subtract(self.a.p[1][i], self.b.p[1][j], out=t)
            yield i, j, _length(d, t), t, whole


def _length(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Square root of the sum of squares, in place of dx; as in SQL, and a fraction of the time of ``hypot``."""
    np.multiply(dx, dx, out=dx)
    np.multiply(dy, dy, out=dy)
    np.add(dx, dy, out=dx)
    return np.sqrt(dx, out=dx)


def meet(blocks: DataFrame, pairs: list[tuple[int, int]], size: int, cols: int, fold: Callable, schema: str) -> DataFrame:
    """What ``fold`` makes of the blocks of each pair, written once.  ``fold`` gets (same block or not, locations, locations) in turn."""
    spark = blocks.sparkSession
    tasks = int(min(max(2 * spark.sparkContext.defaultParallelism, len(pairs) * float(size) ** 2 / TASK_PAIRS), 4096))
    # Either block of a pair may be the one that travels, so that none travels to most others.
    named = spark.createDataFrame([(a, b) if (a + b) % 2 else (b, a) for a, b in pairs], "a long, b long")
    data = blocks.select("block", "data")
    first = data.withColumnsRenamed({"block": "a", "data": "pa"}).join(named, "a").repartition(tasks, "b")
    second = data.withColumnsRenamed({"block": "b", "data": "pb"}).repartition(tasks, "b")
    both = first.join(second, "b").select((F.col("a") == F.col("b")).alias("own"), "pa", "pb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given():
            for batch in batches:
                for own, p, q in zip(batch.column(0), batch.column(1), batch.column(2)):
                    yield own.as_py(), *(np.frombuffer(v.as_buffer()).reshape(cols, -1) for v in (p, q))
        yield from fold(given())

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(max(1, BATCH // (16 * cols * size)))}):
        return staged(both.mapInArrow(run, schema), "met")
