"""Group comparisons and correlation tests from sufficient statistics.

Each test reduces its data in one or two partially aggregated passes.  Closing
formulas are columns on the reduced rows; only tail probabilities go through an
Arrow batch helper, on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tails
from ..session import cut_lineage
from .joins import natural_inner
from .ordered import quantile_columns, running_totals
from .ranks import ROW, numbered_rows, rank_columns
from .reshape import melt


def group_moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Count, mean and within sum of squares per group (no catastrophic cancellation)."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                          (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance per key: SS, df, F, p and R squared."""
    df, ks = _keyed(df, keys)
    m = group_moments(df, ks, group, value)
    grand = m.groupBy(*ks).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__g"))
    off = F.col("mean") - F.col("__g")
    a = natural_inner(m, grand, ks).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ss_within"),
        F.sum(F.col("n") * off * off).alias("ss_between"))
    a = a.withColumns({"df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")})
    a = a.withColumns({"ms_between": F.try_divide("ss_between", "df_between"),
                       "ms_within": F.try_divide("ss_within", "df_within")})
    a = a.withColumn("f", F.try_divide("ms_between", "ms_within"))
    a = a.withColumn("r_squared", F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")))
    a = a.withColumn("p", tails.fisher_tail("f", "df_between", "df_within"))
    return a.select(*keys, "df_between", "df_within", "ss_between", "ss_within", "ms_between", "ms_within",
                    "f", "p", "r_squared")


def tukey(df: DataFrame, keys: Sequence[str], group: str, value: str, conf: float = 0.95) -> DataFrame:
    """Pairwise differences of level means with family-wise p and interval."""
    df, ks = _keyed(df, keys)
    m = group_moments(df, ks, group, value)
    err = m.groupBy(*ks).agg(F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"),
                             F.sum("ss").alias("__ss"))
    lo = m.select(*ks, F.col(group).alias("group_lo"), F.col("n").alias("__n0"), F.col("mean").alias("__m0"))
    hi = m.select(*ks, F.col(group).alias("group_hi"), F.col("n").alias("__n1"), F.col("mean").alias("__m1"))
    # One row per factor level on each side: a comparison table of level pairs.
    pairs = lo.join(hi, ks).filter(F.col("group_lo") < F.col("group_hi")).join(err, ks)
    pairs = pairs.withColumn("estimate", F.col("__m1") - F.col("__m0"))
    mse = F.try_divide(F.col("__ss"), F.col("df"))
    pairs = pairs.withColumn("se", F.sqrt(mse / 2.0 * (1.0 / F.col("__n0") + 1.0 / F.col("__n1"))))
    pairs = pairs.withColumn("q", F.try_divide(F.abs("estimate"), F.col("se")))
    pairs = pairs.withColumn("p_adj", tails.tukey_tail("q", "k", "df"))
    half = tails.tukey_cut(F.lit(1.0 - conf), "k", "df") * F.col("se")
    return pairs.withColumn("__h", half).select(
        *keys, "group_lo", "group_hi", "estimate", "se", "q", (F.col("estimate") - F.col("__h")).alias("conf_low"),
        (F.col("estimate") + F.col("__h")).alias("conf_high"), "p_adj")


def letter_code(i: int) -> str:
    """0, 1, .. as a, .., z, aa, ab, ..: never runs out."""
    code, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        code = chr(97 + r) + code
    return code


def compact_letters(means: list[float], different: list[tuple[int, int]]) -> list[list[int]]:
    """Letters of each level by insert-and-absorb (levels are numbered by ascending mean).

    Starting from one column with all levels, every differing pair splits the columns that hold both;
    a column inside another one is absorbed.  Two levels share a letter exactly if they do not differ.
    """
    columns = [frozenset(range(len(means)))]
    for a, b in different:
        split = []
        for c in columns:
            split += [c - {a}, c - {b}] if a in c and b in c else [c]
        columns = []
        for c in sorted(set(split), key=len, reverse=True):
            if not any(c <= d for d in columns):
                columns.append(c)
    columns.sort(key=sorted)
    return [[n for n, c in enumerate(columns) if i in c] for i in range(len(means))]


def letters(df: DataFrame, keys: Sequence[str], group: str, value: str, level: float = 0.05) -> DataFrame:
    """Compact letters: two levels of a key share a letter exactly if they do not differ.

    A task holds the comparison table of one key: pairs of its factor levels, not rows.
    """
    df, ks = _keyed(df, keys)
    m = group_moments(df, ks, group, value).select(*ks, F.col(group).alias("group_lo"), F.lit(None).cast(
        dict(df.dtypes)[group]).alias("group_hi"), "mean", F.lit(None).cast("boolean").alias("differ"))
    t = tukey(df, ks, group, value).select(*ks, "group_lo", "group_hi", F.lit(None).cast("double").alias("mean"),
                                          (F.col("p_adj") < level).alias("differ"))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*ks, group)) + ", letters string"

    def display(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = pdf[pdf["mean"].notna()].sort_values(["mean", "group_lo"])
        place = {g: i for i, g in enumerate(levels["group_lo"])}
        apart = pdf[pdf["mean"].isna() & pdf["differ"].eq(True)]
        pairs = sorted(tuple(sorted((place[a], place[b]))) for a, b in zip(apart["group_lo"], apart["group_hi"]))
        found = compact_letters(levels["mean"].tolist(), pairs)
        out = {c: levels[c].tolist() for c in ks}
        return pd.DataFrame(out | {group: levels["group_lo"].tolist(), "letters": ["".join(map(letter_code, x)) for x in found]})

    return m.unionByName(t).groupBy(*ks).applyInPandas(display, schema).select(*keys, group, "letters")


def median_test(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Two-sample median test (asymptotic): standardised count above the pooled median."""
    df, ks = _keyed(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()), keys)
    med = quantile_columns(df, ks, value, {"median": 0.5})
    above = natural_inner(df, med, ks).withColumn("hi", (F.col(value) > F.col("median")).cast("double"))
    g = above.groupBy(*ks, group).agg(F.count(F.lit(1)).alias("n"), F.sum("hi").alias("t"), F.first("median").alias("median"))
    r = g.groupBy(*ks).agg(F.min_by("n", group).alias("n1"), F.min_by("t", group).alias("above1"),
                           F.sum("n").alias("n"), F.sum("t").alias("above"), F.first("median").alias("median"))
    share = F.col("above") / F.col("n")
    var = F.try_divide(F.col("n1") * (F.col("n") - F.col("n1")) * share * (1 - share), (F.col("n") - 1).cast("double"))
    r = r.withColumn("z", F.try_divide(F.col("above1") - F.col("n1") * share, F.sqrt(var)))
    return r.select(*keys, "median", "n1", "n", F.col("above1").cast("bigint").alias("above1"),
                    "z", tails.normal_tail("z").alias("p"))


def ks_two_sample(df: DataFrame, keys: Sequence[str], group: str, value: str, first: str, second: str,
                  exact: bool = False) -> DataFrame:
    """Largest gap between two empirical distributions, with its two-sided p.

    The p-value is the limiting one for every sample size; ``exact`` asks for the exact law (an upper
    bound with ties), whose cost is the product of the sample sizes.  A key that lacks one of the samples
    has a null gap and p.
    """
    df, ks = _keyed(df.filter(F.col(group).isin(first, second)), keys)
    marks = df.withColumns({"a": (F.col(group) == first).cast("bigint"), "b": (F.col(group) == second).cast("bigint")})
    c = running_totals(marks, ks, value, ["a", "b"])
    gap = F.abs(F.try_divide(F.col("a_before") + F.col("a"), F.col("a_total"))
                - F.try_divide(F.col("b_before") + F.col("b"), F.col("b_total")))
    d = c.groupBy(*ks).agg(F.max(gap).alias("d"), F.first("a_total").alias("n1"), F.first("b_total").alias("n2"))
    tail = tails.ks_exact_tail if exact else tails.ks_tail
    return d.select(*keys, "d", "n1", "n2", tail("d", "n1", "n2").alias("p"))


def _corr_row(r, n):
    t = F.try_divide(r * F.sqrt(n - 2.0), F.sqrt(1.0 - r * r))
    return t


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation with its t statistic and two-sided p by group."""
    df, ks = _keyed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    c = df.groupBy(*ks).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("t", _corr_row(F.col("r"), F.col("n")))
    return c.select(*keys, "r", "n", "t", tails.student_tail("t", F.col("n") - 2).alias("p"))


def with_ranks(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Tie-averaged ranks beside each row as ``rank_<col>``; a missing value has none."""
    base = numbered_rows(df)
    return base.join(rank_columns(base, keys, cols), ROW, "left").drop(ROW)


SMALL_SAMPLE = 1290     # rows of a group below which ``small_sample`` leaves the t approximation


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, small_sample: bool = False) -> DataFrame:
    """Rank correlation test by group (t approximation).

    With ``small_sample``, p of a group without ties and of fewer than ``SMALL_SAMPLE`` rows follows the law of
    the squared rank distances instead: counted out for few rows, by its Edgeworth series for more.
    """
    df, ks = _keyed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    ranked = with_ranks(df.select(*ks, x, y), ks, [x, y])
    if not small_sample:
        out = pearson(ranked, ks, f"rank_{x}", f"rank_{y}")
        return out.select(*keys, F.col("r").alias("rho"), "n", "t", "p")
    rx, ry = F.col(f"rank_{x}"), F.col(f"rank_{y}")
    c = ranked.groupBy(*ks).agg(F.corr(rx, ry).alias("rho"), F.count(F.lit(1)).alias("n"), F.least(F.sum(rx * rx), F.sum(ry * ry)).alias("__squares"))
    n = F.col("n").cast("double")
    # Ties lower the sum of squared ranks by a half at least.  Only small groups are asked for it, where it is exact.
    exact = (n < SMALL_SAMPLE) & (F.col("__squares") > n * (n + 1) * (2 * n + 1) / 6 - 0.25)
    c = c.withColumn("t", _corr_row(F.col("rho"), F.col("n")))
    small, usual = tails.spearman_tail("rho", F.when(exact, n)), tails.student_tail("t", F.col("n") - 2)
    return c.select(*keys, "rho", "n", "t", F.coalesce(small, usual).alias("p"))


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise rank correlations as ``var1 < var2, rho`` from one aggregation."""
    complete = df.select(*cols).dropna()
    ranked = rank_columns(numbered_rows(complete), [], cols)
    pairs = [tuple(sorted(p)) for p in combinations(cols, 2)]
    rhos = cut_lineage(ranked.agg(*[F.corr(f"rank_{a}", f"rank_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)]))     # one row
    spec = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"c{i}").alias("rho"))
                     for i, (a, b) in enumerate(pairs)])
    return rhos.select(F.explode(spec).alias("p")).select("p.*")


def collinear_pairs(matrix: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pairs at or beyond the limit, strongest first."""
    return matrix.filter(F.abs("rho") >= limit).orderBy(F.abs("rho").desc(), "var1", "var2")


def independence_mask(matrix: DataFrame, limit: float = 0.5) -> DataFrame:
    """Lower-triangle mask of pairs allowed in one model."""
    return matrix.select("var1", "var2", (F.abs("rho") <= limit).alias("allowed"))


def _mix(h: np.ndarray) -> np.ndarray:
    """64-bit integer finaliser (splitmix), vectorised."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hash_uniform(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms in (0, 1) that depend only on row id, replicate and seed."""
    with np.errstate(over="ignore"):
        a = _mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        h = _mix(a[:, None] ^ (_mix(reps.astype(np.uint64) + np.uint64(1))[None, :]))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


_POISSON1 = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1)) if k else 1) for k in range(16)])


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, row_id: Sequence[str], reps: int = 1000,
                   conf: float = 0.95, seed: int = 1, min_partitions: int | None = None) -> DataFrame:
    """Mean with percentile bootstrap limits per group.

    Every row gets a Poisson(1) weight per replicate from a hash of its id, so
    the result does not depend on partitioning.  Partitions emit weighted sums
    per (group, replicate); resampled rows are never materialised.
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        F.struct(*keys).alias("g"), F.to_json(F.struct(*keys)).alias("gk"),
        F.xxhash64(*row_id).alias("id"), F.col(value).cast("double").alias("v"))

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        rep = np.arange(reps)
        for pdf in batches:
            for gk, part in pdf.groupby("gk", sort=False):
                acc = sums.setdefault(gk, np.zeros((2, reps)))
                for start in range(0, len(part), 2048):
                    chunk = part.iloc[start:start + 2048]
                    w = np.searchsorted(_POISSON1, hash_uniform(chunk["id"].to_numpy(), rep, seed), side="right")
                    acc[0] += w.sum(axis=0)
                    acc[1] += chunk["v"].to_numpy() @ w
        for gk, acc in sums.items():
            yield pd.DataFrame({"gk": gk, "rep": rep, "w": acc[0], "wv": acc[1]})

    spread = rows.select("gk", "id", "v")
    if min_partitions and spread.rdd.getNumPartitions() < min_partitions:
        spread = spread.repartition(min_partitions)
    parts = spread.mapInPandas(partial, "gk string, rep int, w double, wv double")
    means = parts.groupBy("gk", "rep").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    tail = (1.0 - conf) / 2.0
    # ``reps`` rows per group: bounded, so the built-in percentile is fine.
    lim = means.groupBy("gk").agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))
    base = rows.groupBy("g", "gk").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return base.join(lim, "gk").select("g.*", "mean", "lower", "upper", "n")
