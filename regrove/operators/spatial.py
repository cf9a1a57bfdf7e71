"""Distance operators on point tables: nearest feature, close pairs, variogram.

None of them plans a product join.  Exact copies of a location are merged first
and carried as weights, and space is cut into square cells until no cell holds
more than a fixed number of distinct locations, so a dense spot or a pile of
copies never becomes one task's work.
"""

from __future__ import annotations

import math
from decimal import Decimal
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, discard
from .blocks import Chunks, Distances, limits, meet, packed, reach, slabs
from .ordered import running_totals

LEAF_POINTS = 256
MAX_LEVELS = 24
BINS = 4096
CHUNK = 32              # locations of a chunk, for the pairwise median


def distance(x1, y1, x2, y2) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.hypot(c(x1) - c(x2), c(y1) - c(y2))


@dataclass(frozen=True)
class Quad:
    """A square cut ``levels`` times into quarters; cell (i, j) is counted from the low corner."""
    x0: float
    y0: float
    size: float
    levels: int

    def side(self, level: int) -> float:
        return self.size / (1 << level)

    def cell(self, x: str, y: str, level: int) -> tuple[Column, Column]:
        top = (1 << level) - 1
        side = F.lit(self.side(level))
        i = F.least(F.floor((F.col(x) - F.lit(self.x0)) / side), F.lit(top))
        j = F.least(F.floor((F.col(y) - F.lit(self.y0)) / side), F.lit(top))
        return i.cast("int"), j.cast("int")


def _fit_quad(tables: Sequence[tuple[DataFrame, str, str]], dense: tuple[DataFrame, str, str],
              leaf_points: int) -> Quad | None:
    """Common square of all tables, cut until the dense table's cells are small."""
    box = None
    for df, x, y in tables:
        r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).first()
        if r[4] == 0:
            return None
        box = list(r) if box is None else [min(box[0], r[0]), max(box[1], r[1]), min(box[2], r[2]),
                                           max(box[3], r[3]), max(box[4], r[4])]
    size = max(box[1] - box[0], box[3] - box[2], 1e-9) * (1 + 1e-9)
    df, x, y = dense
    level = max(1, math.ceil(math.log(max(box[4], 4) / leaf_points * 4, 4)))
    while True:
        q = Quad(box[0], box[2], size, level)
        i, j = q.cell(x, y, level)
        most = df.groupBy(i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most <= leaf_points or level >= MAX_LEVELS:
            return q
        level = min(MAX_LEVELS, level + max(1, math.ceil(math.log(most / leaf_points, 4))))


def _gap(lo_a, hi_a, lo_b, hi_b) -> tuple[Column, Column]:
    """Smallest and largest separation of two intervals."""
    near = F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))
    far = F.greatest(hi_b - lo_a, hi_a - lo_b)
    return near, far


def _boxes(df: DataFrame, i: Column, j: Column, x: tuple[str, str], y: tuple[str, str], e: str) -> DataFrame:
    """Box of what is in each cell: ``i<e>, j<e>`` and the limits of x and y."""
    return df.groupBy(i.alias(f"i{e}"), j.alias(f"j{e}")).agg(F.min(x[0]).alias(f"xlo_{e}"), F.max(x[1]).alias(f"xhi_{e}"),
                                                              F.min(y[0]).alias(f"ylo_{e}"), F.max(y[1]).alias(f"yhi_{e}"))


def nearest_feature(points: DataFrame, features: DataFrame, x: str = "x", y: str = "y",
                    fx: str = "fx", fy: str = "fy", name: str = "distance",
                    leaf_points: int = LEAF_POINTS, work: list | None = None) -> DataFrame:
    """Distance from every point to its nearest feature; null without features.

    A joint descent: cells of points and cells of features are split together, from one pair that holds everything.  A
    cell of points keeps the feature cells that could still hold the nearest feature of one of its points: their near side must
    not lie beyond the far side of the best one.  So far cells are given up once for a whole coarse cell of points, and the
    pairs of a level grow with the occupied cells of that level.  Distances are computed only against the features of
    the surviving leaves.  ``work`` is a list to which the numbers of pairs kept at each level are added.
    """
    where = points.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
    feats = features.select(fx, fy).filter(F.col(fx).isNotNull() & F.col(fy).isNotNull()).distinct()
    quad = _fit_quad([(where, x, y), (feats, fx, fy)], (feats, fx, fy), leaf_points)
    if quad is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    leaf = quad.levels
    pi, pj = quad.cell(x, y, leaf)
    qi, qj = quad.cell(fx, fy, leaf)
    where = where.withColumns({"ip": pi, "jp": pj})
    feats = feats.withColumns({"iq": qi, "jq": qj})
    leaves_p = cut_lineage(_boxes(where, F.col("ip"), F.col("jp"), (x, x), (y, y), "p"))
    leaves_q = cut_lineage(_boxes(feats, F.col("iq"), F.col("jq"), (fx, fx), (fy, fy), "q"))
    cand = points.sparkSession.createDataFrame([(0, 0, 0, 0)], "ip int, jp int, iq int, jq int")
    best, level = Window.partitionBy("ip", "jp"), 0
    while level < leaf:
        stride = min(2, leaf - level)
        level, side = level + stride, 1 << stride
        quarter = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
        kids = cand
        for e, leaves in (("p", leaves_p), ("q", leaves_q)):
            here = _boxes(leaves, F.shiftright(f"i{e}", leaf - level), F.shiftright(f"j{e}", leaf - level), (f"xlo_{e}", f"xhi_{e}"), (f"ylo_{e}", f"yhi_{e}"), e)
            kids = kids.withColumn("k", quarter).withColumns({f"i{e}": F.col(f"i{e}") * side + F.col("k") % side,
                                                              f"j{e}": F.col(f"j{e}") * side + F.shiftright("k", stride)}).drop("k")
            kids = kids.join(here, [f"i{e}", f"j{e}"])
        (nx, far_x), (ny, far_y) = (_gap(*[F.col(f"{c}{end}_{e}") for e in "pq" for end in ("lo", "hi")]) for c in "xy")
        kids = kids.select("ip", "jp", "iq", "jq", (F.hypot(nx, ny) * (1 - 1e-9)).alias("near"), (F.hypot(far_x, far_y) * (1 + 1e-9)).alias("far"))
        cand = cut_lineage(kids.withColumn("cut", F.min("far").over(best)).filter("near <= cut").select("ip", "jp", "iq", "jq"))
        if work is not None:
            work.append(cand.count())
    reach = where.join(cand, ["ip", "jp"]).join(feats, ["iq", "jq"])
    found = reach.groupBy(x, y).agg(F.min(distance(x, y, fx, fy)).alias(name))
    return points.join(found, [x, y], "left").select(*points.columns, name)


def _locations(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Distinct locations with copies folded into sums."""
    keep = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    keep = keep.filter(F.col(z).isNotNull()) if z else keep
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    if z:
        zz = F.col(z).cast("double")
        aggs += [F.sum(zz).alias("s"), F.sum(zz * zz).alias("ss")]
    return keep.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(*aggs)


def close_locations(locs: DataFrame, cutoff: float, payload: Sequence[str], block: int = 2048) -> DataFrame:
    """Each unordered pair of distinct locations within ``cutoff``, once.

    Locations meet in cells as wide as the cutoff.  A cell with more than
    ``block`` locations is dealt into blocks, and block pairs become the join key,
    so every key joins at most ``block`` by ``block`` rows.  Output columns carry
    suffixes ``_a`` and ``_b``; ``d`` is the distance.
    """
    side = F.lit(float(cutoff))
    p = locs.withColumns({"ci": F.floor(F.col("x") / side), "cj": F.floor(F.col("y") / side)})
    cells = p.groupBy("ci", "cj").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("k"))
    half = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"))
                     for i, j in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))])
    near = cells.withColumn("o", F.explode(half)).select(
        "ci", "cj", F.col("k").alias("ka"), (F.col("ci") + F.col("o.di")).alias("ei"),
        (F.col("cj") + F.col("o.dj")).alias("ej"))
    near = near.join(cells.select(F.col("ci").alias("ei"), F.col("cj").alias("ej"), F.col("k").alias("kb")),
                     ["ei", "ej"])
    deal = F.pmod(F.xxhash64("x", "y"), F.col("__own")).cast("int")
    keep = ["x", "y", *payload]
    key = ["ci", "cj", "ei", "ej", "ba", "bb"]
    a = p.join(near, ["ci", "cj"]).withColumn("__own", F.col("ka")).withColumn("ba", deal)
    a = a.withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    a = a.select(*key, *[F.col(c).alias(f"{c}_a") for c in keep])
    b = p.withColumnsRenamed({"ci": "ei", "cj": "ej"}).join(near, ["ei", "ej"]).withColumn(
        "__own", F.col("kb")).withColumn("bb", deal)
    b = b.withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)))
    b = b.select(*key, *[F.col(c).alias(f"{c}_b") for c in keep])
    pairs = a.join(b, key)
    same = (F.col("ci") == F.col("ei")) & (F.col("cj") == F.col("ej"))
    first = (F.col("x_a") < F.col("x_b")) | ((F.col("x_a") == F.col("x_b")) & (F.col("y_a") < F.col("y_b")))
    d = distance("x_a", "y_a", "x_b", "y_b")
    return pairs.filter(~same | first).withColumn("d", d).filter(F.col("d") <= side).select(
        *[f"{c}_{s}" for s in "ab" for c in keep], "d")


TAYLOR = 0.1            # a pair of chunks may spread over this share of its distance for its sum of distances to come from moments


def _distance_sum(a: dict[str, np.ndarray], i, b: dict[str, np.ndarray], j) -> np.ndarray:
    """Sum of the distances between all locations of chunk i of a and of chunk j of b, from moments up to the third.

    With r the distance of the centres, u the part of a pair's deviation along it and v the part across, a distance is
    r + u + v^2 / 2r - u v^2 / 2r^2, and a term of the fourth order is left out.
    """
    dx, dy = b["gx"][j] - a["gx"][i], b["gy"][j] - a["gy"][i]
    r = np.hypot(dx, dy)
    ux, uy = dx / r, dy / r
    na, nb = a["n"][i], b["n"][j]
    two = {m: na * b[m][j] + nb * a[m][i] for m in ("mxx", "mxy", "myy")}
    three = {m: na * b[m][j] - nb * a[m][i] for m in ("mxxx", "mxxy", "mxyy", "myyy")}
    across = two["mxx"] * uy * uy - 2 * two["mxy"] * ux * uy + two["myy"] * ux * ux
    along = (ux * (three["mxxx"] + three["mxyy"]) + uy * (three["mxxy"] + three["myyy"])
             - (ux * ux * ux * three["mxxx"] + 3 * ux * ux * uy * three["mxxy"] + 3 * ux * uy * uy * three["mxyy"] + uy * uy * uy * three["myyy"]))
    return na * nb * r + across / (2 * r) - along / (2 * r * r)


@dataclass(frozen=True)
class _Lags:
    """Lags of a semivariogram, and its sums (weight, weighted distance, squared differences) by lag from pairs of blocks."""
    cutoff: float
    width: float
    last: int
    chunk: int

    def of(self, d: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(d / self.width), self.last)

    def whole(self, near, far, kk) -> np.ndarray:
        """Pairs whose whole range of distances lies in one lag, and is short enough for a series."""
        return (far <= self.cutoff) & (self.of(near) == self.of(far)) & (far - near <= TAYLOR * near) & (kk > 1)

    def add_whole(self, sums: np.ndarray, lags: np.ndarray, a, i, b, j) -> None:
        sq = b["n"][j] * a["ss"][i] + a["n"][i] * b["ss"][j] - 2 * a["s"][i] * b["s"][j]
        for row, v in zip(sums, (a["n"][i] * b["n"][j], _distance_sum(a, i, b, j), sq)):
            np.add.at(row, lags.astype(np.int64), v)

    def fold(self, pairs):
        sums, met = np.zeros((3, self.last + 2)), 0.0
        for own, p, q in pairs:
            a = Chunks(p, self.chunk)
            b = a if own else Chunks(q, self.chunk)
            met += self._pair(sums, a, b, own)
        w, wd, sq = sums[:, :-1]
        lags = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"lag": pa.array(np.append(lags, -1), pa.int32()), "w": np.append(w[lags], met), "wd": np.append(wd[lags], 0.0),
                                          "sq": np.append(sq[lags], 0.0)})

    def _pair(self, sums: np.ndarray, a: Chunks, b: Chunks, own: bool) -> float:
        met, distances = 0.0, Distances(a, b)
        for lo, near, far, once in slabs(a, b, own):
            keep = once & (near <= self.cutoff)
            kk = a.sums["k"][lo:lo + len(near), None] * b.sums["k"]
            whole = keep & self.whole(near, far, kk)
            i, j = np.nonzero(whole)
            if len(i):
                self.add_whole(sums, self.of(near[i, j]), a.sums, i + lo, b.sums, j)
            keep &= ~whole
            met += float(kk[keep].sum())
            for r in np.flatnonzero(keep.any(axis=1)):
                others = np.flatnonzero(keep[r])
                base, edge = int(self.of(near[r, others]).min()), bool((far[r, others] > self.cutoff).any())
                for one, two, d, t, lag in distances.met(lo + r, others, own):
                    np.divide(d, self.width, out=t)
                    np.minimum(t, self.last, out=t)
                    if base:
                        np.subtract(t, base, out=t)
                    np.copyto(lag, t, casting="unsafe")
                    if edge:
                        np.putmask(lag, d > self.cutoff, self.last + 1 - base)      # the last place is for these
                    self._add(sums[:, base:], lag.ravel(), d, t, a, one, b, two)
        return met

    @staticmethod
    def _add(sums, lag, d, t, a: Chunks, i, b: Chunks, j) -> None:
        if a.single and b.single:
            w = np.bincount(lag)
            np.subtract(a.p[3][i], b.p[3][j], out=t)
            np.multiply(t, t, out=t)
        else:
            na, nb = a.p[2][i], b.p[2][j]
            both = na * nb
            w = np.bincount(lag, both.ravel())
            d = d * both
            t = nb * a.p[4][i] + na * b.p[4][j] - 2 * a.p[3][i] * b.p[3][j]
        for row, v in zip(sums, (w, np.bincount(lag, d.ravel()), np.bincount(lag, t.ravel()))):
            row[:len(v)] += v


def semivariogram(points: DataFrame, value: str, cutoff: float, width: float, x: str = "x", y: str = "y", block: int = 64,
                  work: list | None = None) -> DataFrame:
    """Empirical semivariogram: ``lag, np, dist, gamma`` for pairs within the cutoff.

    Works on pairs of blocks, then of chunks of at most ``block / 2`` locations.  Pairs beyond the cutoff are dropped.  A pair whose whole range
    of distances lies in one lag gives its numbers from moments: ``np`` and ``gamma`` exactly, the sum of distances by a series whose error is some
    1e-8 of it.  The locations of other pairs of chunks are met one by one and folded into lag sums at once.  Where a lag is wide beside a chunk, only
    pairs near a lag's border or closer than a few chunks are met; where it is narrow, all pairs within the cutoff are, in bounded memory.
    ``work`` is a list to which the number of pairs met one by one is added.
    """
    locs = cut_lineage(_locations(points, x, y, value))
    spark = points.sparkSession
    lags = _Lags(float(cutoff), float(width), math.ceil(cutoff / width - 1e-9) - 1, max(1, block // 2))
    moment_sums = [F.sum(c).alias(c) for c in ("w", "wd", "sq")]
    found = locs.filter("n > 1").groupBy(F.lit(0).alias("lag")).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("w"), F.lit(0.0).alias("wd"), F.sum(F.col("n") * F.col("ss") - F.col("s") * F.col("s")).alias("sq"))
    quad, n = _square(locs)
    if n:
        blocks = packed(locs, *quad.cell("x", "y", MAX_LEVELS), ["x", "y", "n", "s", "ss"], n)
        ends = limits(blocks)
        sums, pairs = np.zeros((3, lags.last + 1)), []
        for a in range(len(ends["block"])):
            others = np.arange(a, len(ends["block"]))
            near, far = reach(ends, a, ends, others)
            whole = lags.whole(near, far, ends["k"][a] * ends["k"][others]) & (others > a)
            if whole.any():
                lags.add_whole(sums, lags.of(near[whole]), ends, np.full(whole.sum(), a), ends, others[whole])
            pairs += [(int(ends["block"][a]), int(ends["block"][b])) for b in others[(near <= cutoff) & ~whole]]
        met = meet(blocks, pairs, int(ends["k"].max()), 5, lags.fold, "lag int, w double, wd double, sq double")
        discard(blocks)
        if work is not None:
            work.append(met.filter("lag = -1").agg(F.sum("w")).first()[0])
        settled = [(k, *(float(v) for v in sums[:, k])) for k in map(int, np.flatnonzero(sums[0]))]
        found = found.unionByName(met.filter("lag >= 0")).unionByName(spark.createDataFrame(settled, "lag int, w double, wd double, sq double"))
    both = found.groupBy("lag").agg(*moment_sums)
    return both.select("lag", F.col("w").cast("bigint").alias("np"), (F.col("wd") / F.col("w")).alias("dist"), (F.col("sq") / (2 * F.col("w"))).alias("gamma"))


def _square(locs: DataFrame) -> tuple[Quad | None, int]:
    """The square around distinct locations, cut as finely as possible, and their number."""
    box = locs.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not box[4]:
        return None, 0
    return Quad(box[0], box[2], max(box[1] - box[0], box[3] - box[2], 1e-9) * (1 + 1e-9), MAX_LEVELS), box[4]


def variogram_defaults(points: DataFrame, y: str = "y", lags: int = 50) -> tuple[float, float]:
    """Cutoff of half the northing range and its fiftieth part as lag width."""
    lo, hi = points.agg(F.min(y), F.max(y)).first()
    return (hi - lo) / 2.0, (hi - lo) / 2.0 / lags


def _pairs(n: np.ndarray) -> np.ndarray:
    """n * (n - 1) / 2 as exact whole numbers."""
    n = n.astype(np.int64)
    return np.where(n % 2 == 0, n // 2 * (n - 1), (n - 1) // 2 * n)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * b.astype(np.int64)


def _reached(values: np.ndarray, weights: np.ndarray, rank: int) -> int:
    """Place, in increasing order of values, of the one that holds a rank."""
    order = np.argsort(values, kind="stable")
    return int(order[np.searchsorted(np.cumsum(weights[order]), rank, side="right")])


@dataclass(frozen=True)
class _Bracket:
    """Distances from ``low`` to ``high`` in ``BINS`` bins, with one bin below and one above; counts come from pairs of blocks."""
    low: float
    high: float
    first: int = 0      # the bins that are asked for
    last: int = BINS + 1

    @property
    def step(self) -> float:
        return max((self.high - self.low) / BINS, 1e-12)

    def bins(self, d: np.ndarray, out: np.ndarray | None = None, whole: np.ndarray | None = None) -> np.ndarray:
        """Bin of each distance, counted from the one below the bracket."""
        out = np.empty(d.shape) if out is None else out
        np.subtract(d, self.low, out=out)
        np.divide(out, self.step, out=out)
        np.add(out, 1, out=out)
        np.clip(out, 0, BINS + 1, out=out)
        whole = np.empty(d.shape, np.int64) if whole is None else whole
        np.copyto(whole, out, casting="unsafe")
        return whole

    def between(self, first: int, last: int) -> tuple[float, float]:
        """The distances of some bins and a hair beyond; the outer bins end where the bracket does."""
        hair = 1e-3 * self.step
        return max(self.low, self.low + (first - 1) * self.step - hair), min(self.high, self.low + last * self.step + hair)

    @property
    def span(self) -> tuple[float, float]:
        return self.between(self.first, self.last)

    def ranges(self, pairs):
        """Numbers of pairs whose chunks' least (side 0) and greatest (side 1) distance lies in each bin."""
        found = np.zeros((2, BINS + 2), np.int64)
        for own, p, q in pairs:
            a = Chunks(p, CHUNK)
            b = a if own else Chunks(q, CHUNK)
            for lo, near, far, once in slabs(a, b, own):
                w = self._weights(a, b, own, lo, near.shape)[once]
                for side, d in enumerate((near, far)):
                    np.add.at(found[side], self.bins(d[once]), w)
        side, at = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"side": pa.array(side, pa.int32()), "b": pa.array(at, pa.int32()), "w": pa.array(found[side, at], pa.int64())})

    def counted(self, pairs):
        """Numbers of pairs of locations by bin; those outside the bracket from their chunks alone, if they suffice."""
        found = np.zeros(BINS + 2, np.int64)
        for d, w, bins in self._undecided(pairs, found):
            if w is None:
                found += np.bincount(bins.ravel(), minlength=BINS + 2)
            else:
                np.add.at(found, bins.ravel(), w.ravel())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"b": pa.array(at, pa.int32()), "w": pa.array(found[at], pa.int64())})

    def listed(self, pairs):
        """The distances of some bins, each once for some pairs of chunks, with the numbers of pairs."""
        for d, w, bins in self._undecided(pairs, np.zeros(BINS + 2, np.int64)):
            here = (bins >= self.first) & (bins <= self.last)
            if here.any():
                values, at = np.unique(d[here], return_inverse=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, at.ravel(), 1 if w is None else w[here])
                yield pa.RecordBatch.from_pydict({"d": values, "w": sums})

    @staticmethod
    def _weights(a: Chunks, b: Chunks, own: bool, lo: int, shape) -> np.ndarray:
        w = _between(a.sums["n"][lo:lo + shape[0], None], b.sums["n"][None, :])
        if own:
            i = np.arange(shape[0])
            w[i, i + lo] = _pairs(a.sums["n"][i + lo])
        return w

    def _undecided(self, pairs, outside: np.ndarray):
        """(distances, numbers of pairs or None for one each, bins) of pairs of locations; what lies below the bracket for certain is counted in ``outside``."""
        for own, p, q in pairs:
            a = Chunks(p, CHUNK)
            b = a if own else Chunks(q, CHUNK)
            distances, single, (low, high) = Distances(a, b), a.single and b.single, self.span
            for lo, near, far, once in slabs(a, b, own):
                under = once & (far < low)
                outside[0] += self._weights(a, b, own, lo, near.shape)[under].sum()
                keep = once & ~under & (near <= high)
                for r in np.flatnonzero(keep.any(axis=1)):
                    others = np.flatnonzero(keep[r])
                    for i, j, d, t, whole in distances.met(lo + r, others, own):
                        yield d, None if single else _between(a.p[2][i], b.p[2][j]), self.bins(d, t, whole)
                    if own and not single and keep[r, lo + r]:
                        n = a.p[2][a.at(lo + r)]
                        if (n > 1).any():       # copies of a location
                            d = np.zeros(int((n > 1).sum()))
                            yield d, _pairs(n[n > 1]), self.bins(d)


def pair_distance_median(points: DataFrame, x: str = "x", y: str = "y", stop_at: float = 2e7) -> DataFrame:
    """Exact median of all pairwise distances: one row ``n_pairs, median_distance``.

    A bracket around the median comes from the limits of pairs of blocks, then of pairs of chunks of locations.  Only
    locations of chunks that may lie in the bracket are met, and counted by bin of it; the bin of the median is the next
    bracket, until it holds at most ``stop_at`` pairs.  Only the distances of that bin are ever listed and sorted.
    """
    spark = points.sparkSession
    locs = cut_lineage(_locations(points, x, y))
    schema = "n_pairs bigint, median_distance double"
    m = int(locs.agg(F.sum("n")).first()[0] or 0)
    m = m * (m - 1) // 2
    if m == 0:
        return spark.createDataFrame([(0, None)], schema)
    quad, n = _square(locs)
    blocks = packed(locs, *quad.cell("x", "y", MAX_LEVELS), ["x", "y", "n"], n)
    ends = limits(blocks)
    ranks = ((m - 1) // 2, m // 2)
    one, two = np.triu_indices(len(ends["block"]))      # blocks are few, some sqrt(n) / 12
    near, far = reach(ends, one, ends, two)
    weight = np.where(one == two, _pairs(ends["n"][one]), _between(ends["n"][one], ends["n"][two]))
    bracket = _Bracket(float(near[_reached(near, weight, ranks[0])]), float(far[_reached(far, weight, ranks[1])]))

    def settle(fold, schema: str) -> tuple[int, DataFrame]:
        """Pairs below the bracket by their blocks, and what the undecided pairs of blocks give."""
        low, high = bracket.span
        may = (far >= low) & (near <= high)
        named = [(int(ends["block"][a]), int(ends["block"][b])) for a, b in zip(one[may], two[may])]
        return int(weight[far < low].sum()), meet(blocks, named, int(ends["k"].max()), 3, fold, schema)

    def at_rank(rows, below: int, rank: int) -> tuple[int, int]:
        """Bin that holds a rank, and the pairs before it; at most BINS + 2 rows."""
        for b, w in sorted(rows):
            if below + w > rank:
                return b, below
            below += w
        raise ValueError("pairs are missing")

    below, hist = settle(bracket.ranges, "side int, b int, w long")
    rows = hist.groupBy("side", "b").agg(F.sum("w").alias("w")).collect()
    first, last = (at_rank([(b, w) for s, b, w in rows if s == side], below, rank)[0] for side, rank in enumerate(ranks))
    bracket = _Bracket(*bracket.between(first, last))
    while True:
        below, hist = settle(bracket.counted, "b int, w long")
        rows = [tuple(r) for r in hist.groupBy("b").agg(F.sum("w").alias("w")).collect()]
        (first, start), (last, _) = (at_rank(rows, below, rank) for rank in ranks)
        low, high = bracket.between(first, last)
        if sum(w for b, w in rows if first <= b <= last) <= stop_at or not high - low < (bracket.high - bracket.low) / 2:
            break
        bracket = _Bracket(low, high)
    bracket = _Bracket(bracket.low, bracket.high, first, last)
    _, chosen = settle(bracket.listed, "d double, w long")
    discard(blocks)
    per = chosen.groupBy("d").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    pos = running_totals(cut_lineage(per), [], "d", ["w"])  # one bin's distances, met once
    got = pos.select("d", (F.col("w_before") + F.lit(Decimal(start))).alias("lo"), (F.col("w_before") + F.col("w") + F.lit(Decimal(start))).alias("hi"))
    pick = lambda r: F.min(F.when((F.col("lo") <= F.lit(Decimal(r))) & (F.col("hi") > F.lit(Decimal(r))), F.col("d")))
    middle = got.agg(((pick(ranks[0]) + pick(ranks[1])) / 2.0).alias("v")).first()[0]
    return spark.createDataFrame([(m, middle)], schema)
