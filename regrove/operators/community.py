"""Community composition: dissimilarity, ANOSIM and NMDS.

All-pairs statistics on presence/absence data depend on a site only through the
set of species present.  Sites are therefore folded into composition patterns
(at most ``2**S - 1`` for S declared species, whatever the number of sites) with
counts, and site pairs are represented by pattern pairs with multiplicities.
The results are exact, and no site pair is ever emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .reshape import cast_wide

MAX_SPECIES = 12  # keeps the pattern table below 4,096 rows


def species_matrix(rows: DataFrame, ids: Sequence[str], species: str, levels: Sequence[str], value: str) -> DataFrame:
    """Sites by species, several rows summed, absent species 0."""
    return cast_wide(rows, ids, species, levels, [value], fill=0.0, agg=F.sum)


def change_dissimilarity(rows: DataFrame, plot: Sequence[str], time: str, before, after, species: str,
                         levels: Sequence[str], value: str, digits: int = 0) -> DataFrame:
    """Bray-Curtis dissimilarity between two visits of each plot.

    Abundances are summed per species and rounded half to even.  An empty visit
    is left out, so its plot has no dissimilarity; a plot empty twice is dropped.
    """
    keep = rows.filter(F.col(species).isin(list(levels)) & F.col(time).isin(before, after))
    side = lambda t: F.bround(F.coalesce(F.sum(F.when(F.col(time) == F.lit(t), F.col(value))), F.lit(0.0)), digits)
    per = keep.groupBy(*plot, species).agg(side(before).alias("a"), side(after).alias("b"))
    s = per.groupBy(*plot).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("diff"), F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    s = s.filter((F.col("ta") > 0) | (F.col("tb") > 0))
    both = (F.col("ta") > 0) & (F.col("tb") > 0)
    return s.select(*plot, F.when(both, F.try_divide(F.col("diff"), F.col("ta") + F.col("tb"))).alias("bray"))


def _check(levels: Sequence[str]) -> None:
    if len(levels) > MAX_SPECIES:
        raise ValueError(f"composition patterns support at most {MAX_SPECIES} species, got {len(levels)}")


def site_patterns(rows: DataFrame, site: Sequence[str], species: str, levels: Sequence[str], value: str | None = None) -> DataFrame:
    """Each site's species set as a bit mask (empty sites dropped)."""
    _check(levels)
    there = F.lit(True) if value is None else F.col(value) > 0
    bit = None
    for i, lv in enumerate(levels):
        bit = (F if bit is None else bit).when((F.col(species) == F.lit(lv)) & there, F.lit(1 << i))
    return rows.groupBy(*site).agg(F.bit_or(bit.otherwise(F.lit(0))).alias("pattern")).filter("pattern > 0")


def pattern_counts(sites: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return sites.groupBy("pattern", *groups).agg(F.count(F.lit(1)).alias("n"))


def pattern_dissimilarity(sites: DataFrame, n_species: int) -> DataFrame:
    """Every unordered pattern pair with its dissimilarity and number of site pairs.

    Partners are enumerated from the fixed code range and met by an equi-join.
    """
    c = pattern_counts(sites)
    a = c.select(F.col("pattern").alias("pattern_a"), F.col("n").alias("n_a"),
                 F.explode(F.sequence(F.col("pattern"), F.lit((1 << n_species) - 1))).alias("pattern_b"))
    p = a.join(c.select(F.col("pattern").alias("pattern_b"), F.col("n").alias("n_b")), "pattern_b")
    bits = lambda x: F.bit_count(x)
    shared = bits(F.col("pattern_a").bitwiseAND(F.col("pattern_b")))
    size = bits(F.col("pattern_a")) + bits(F.col("pattern_b"))
    same = F.col("pattern_a") == F.col("pattern_b")
    pairs = F.when(same, F.floor(F.col("n_a") * (F.col("n_a") - 1) / 2)).otherwise(F.col("n_a") * F.col("n_b"))
    return p.select("pattern_a", "pattern_b", "n_a", "n_b", pairs.cast("bigint").alias("n_pairs"),
                    ((size - 2 * shared) / size).alias("bray"))


def _bray_matrix(patterns: np.ndarray) -> np.ndarray:
    bits = (patterns[:, None] >> np.arange(MAX_SPECIES)[None, :]) & 1
    size = bits.sum(axis=1)
    total = size[:, None] + size[None, :]
    return (total - 2 * (bits @ bits.T)) / total


def _pair_ranks(d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Tie-averaged rank of every pattern pair's dissimilarity among site pairs."""
    w = np.outer(n, n).astype(float) / 2.0
    np.fill_diagonal(w, n * (n - 1) / 2.0)
    vals, inv = np.unique(d, return_inverse=True)
    per = np.bincount(inv.ravel(), weights=w.ravel(), minlength=len(vals))
    rank = np.cumsum(per) - per + (per + 1) / 2.0
    return rank[inv].reshape(d.shape), float(per.sum())


def _anosim_r(table: np.ndarray, rank: np.ndarray, n: np.ndarray, pairs: float, rank_sum: float) -> float:
    own = np.diag(rank)
    within_w = (table * (table - 1) / 2.0).sum() + sum(
        (t.sum() ** 2 - (t * t).sum()) / 2.0 for t in table.T)
    within_r = sum((t @ rank @ t - own @ t) / 2.0 for t in table.T)
    between_w = pairs - within_w
    if within_w <= 0 or between_w <= 0:
        return float("nan")
    return ((rank_sum - within_r) / between_w - within_r / within_w) / (pairs / 2.0)


def anosim(sites: DataFrame, group: str, permutations: int = 999, seed: int = 1) -> DataFrame:
    """ANOSIM R with a permutation p-value: one row.

    Permuting labels over sites is drawing a random pattern-by-group table with
    the observed margins, so permutations run as tasks over that small table
    (patterns times groups), independently of the number of sites.
    """
    spark = sites.sparkSession
    rows = pattern_counts(sites, [group]).collect()  # patterns x groups
    pats = sorted({r["pattern"] for r in rows})
    grps = sorted({r[group] for r in rows}, key=str)
    table = np.zeros((len(pats), len(grps)))
    for r in rows:
        table[pats.index(r["pattern"]), grps.index(r[group])] = r["n"]
    n = table.sum(axis=1)
    rank, pairs = _pair_ranks(_bray_matrix(np.array(pats)), n)
    w = np.outer(n, n) / 2.0
    np.fill_diagonal(w, n * (n - 1) / 2.0)
    rank_sum = float((w * rank).sum())
    observed = _anosim_r(table, rank, n, pairs, rank_sum)
    sizes = table.sum(axis=0).astype(np.int64)

    def draw(batches):
        for pdf in batches:
            hits = 0
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                left = n.astype(np.int64).copy()
                cols = []
                for size in sizes[:-1]:
                    take = rng.multivariate_hypergeometric(left, int(size), method="marginals")
                    cols.append(take)
                    left -= take
                t = np.stack([*cols, left], axis=1).astype(float)
                hits += _anosim_r(t, rank, n, pairs, rank_sum) >= observed - 1e-12
            yield pd.DataFrame({"hits": [int(hits)], "tried": [len(pdf)]})

    runs = spark.range(0, permutations, 1, 32).mapInPandas(draw, "hits bigint, tried bigint")
    return runs.agg(F.lit(float(observed)).alias("r"), F.lit(int(n.sum())).cast("bigint").alias("n_sites"),
                    F.lit(len(grps)).alias("n_groups"), F.sum("tried").alias("permutations"),
                    ((F.sum("hits") + 1) / (F.sum("tried") + 1)).alias("p"))


def _monotone(target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit (pool adjacent violators)."""
    level, mass, width = [], [], []
    for t, w in zip(target, weight):
        level.append(t); mass.append(w); width.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            t1, w1, k1 = level.pop(), mass.pop(), width.pop()
            both = mass[-1] + w1
            level[-1] = (level[-1] * mass[-1] + t1 * w1) / both
            mass[-1] = both
            width[-1] += k1
    return np.repeat(level, width)


def _ordinate(start: np.ndarray, d: np.ndarray, n: np.ndarray, max_iter: int, tol: float):
    """One NMDS descent: monotone disparities alternated with weighted majorisation."""
    i, j = np.triu_indices(len(n), 1)
    w = n[i] * n[j]
    delta = d[i, j]
    lap = np.zeros_like(d)
    lap[i, j] = lap[j, i] = -w
    np.fill_diagonal(lap, -lap.sum(axis=1))
    inv = np.linalg.pinv(lap)
    x, last = start, np.inf
    for _ in range(max_iter):
        dist = np.hypot(*(x[i] - x[j]).T)
        order = np.lexsort((dist, delta))  # ties in dissimilarity may take unequal disparities
        hat = np.empty_like(dist)
        hat[order] = _monotone(dist[order], w[order])
        stress = np.sqrt((w * (dist - hat) ** 2).sum() / (w * dist ** 2).sum())
        if last - stress < tol:
            break
        last = stress
        ratio = np.where(dist > 1e-12, w * hat / np.maximum(dist, 1e-12), 0.0)
        b = np.zeros_like(d)
        b[i, j] = b[j, i] = -ratio
        np.fill_diagonal(b, -b.sum(axis=1))
        x = inv @ b @ x
        x -= np.average(x, axis=0, weights=n)
        x /= np.sqrt(np.average((x ** 2).sum(axis=1), weights=n))
    return x, float(stress)


def nmds(sites: DataFrame, dims: int = 2, starts: int = 50, max_iter: int = 300, tol: float = 1e-7,
         seed: int = 1) -> DataFrame:
    """Non-metric ordination of composition patterns: ``pattern, n, nmds1.., stress``.

    Random starts run as independent tasks over the bounded pattern table; the
    lowest stress wins.  Axes are principal axes, largest loading positive.
    """
    spark = sites.sparkSession
    rows = sorted((r["pattern"], r["n"]) for r in pattern_counts(sites).collect())  # < 2**MAX_SPECIES
    axes = [f"nmds{k + 1}" for k in range(dims)]
    schema = "pattern int, n bigint, " + ", ".join(f"{a} double" for a in axes) + ", stress double"
    if len(rows) <= dims:
        return spark.createDataFrame([(p, n, *([0.0] * dims), 0.0) for p, n in rows], schema)
    pats, n = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    d = _bray_matrix(pats)

    def run(batches):
        for pdf in batches:
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                x, stress = _ordinate(rng.normal(size=(len(n), dims)), d, n, max_iter, tol)
                yield pd.DataFrame({"rep": [int(rep)], "stress": [stress], "xs": [x.ravel().tolist()]})

    runs = spark.range(0, starts, 1, min(starts, 32)).mapInPandas(run, "rep int, stress double, xs array<double>")
    best = runs.agg(F.min_by(F.struct("xs", "stress"), F.struct("stress", "rep")).alias("b")).first()["b"]
    x = np.array(best["xs"]).reshape(len(n), dims)
    x = x - np.average(x, axis=0, weights=n)
    _, vecs = np.linalg.eigh((x * n[:, None]).T @ x)
    x = x @ vecs[:, ::-1]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), range(dims)])
    return spark.createDataFrame([(int(p), int(c), *map(float, row), float(best["stress"]))
                                  for p, c, row in zip(pats, n, x)], schema)


def site_scores(sites: DataFrame, ordination: DataFrame, dims: int = 2) -> DataFrame:
    """Coordinates of every site (its pattern's point)."""
    return sites.join(ordination.select("pattern", *[f"nmds{k + 1}" for k in range(dims)]), "pattern")


def species_scores(ordination: DataFrame, levels: Sequence[str], dims: int = 2) -> DataFrame:
    """Mean coordinates of the sites that hold each species."""
    axes = [f"nmds{k + 1}" for k in range(dims)]
    tags = F.array(*[F.struct(F.lit(lv).alias("species"), F.lit(1 << i).alias("bit")) for i, lv in enumerate(levels)])
    held = ordination.withColumn("s", F.explode(tags)).filter(F.col("pattern").bitwiseAND(F.col("s.bit")) > 0)
    return held.groupBy(F.col("s.species").alias("species")).agg(
        *[(F.sum(F.col(a) * F.col("n")) / F.sum("n")).alias(a) for a in axes])


def group_centroids(scores: DataFrame, group: Sequence[str], dims: int = 2) -> DataFrame:
    """Mean and standard error of scores by group."""
    from ..functions.missing import std_error
    axes = [f"nmds{k + 1}" for k in range(dims)]
    return scores.groupBy(*group).agg(*[F.avg(a).alias(f"{a}_mean") for a in axes],
                                      *[std_error(a).alias(f"{a}_se") for a in axes])
