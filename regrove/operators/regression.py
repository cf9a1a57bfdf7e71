"""Linear models from moments: one aggregation, then a term-by-term-sized solve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.tails import fisher_p, student_cut, student_p, student_tail


def simple_lm(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group as tidy rows: term, estimate, se, t, p."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"),
        F.count(F.lit(1)).alias("n"))
    s2 = F.try_divide(F.col("syy") - F.col("b") * F.col("sxy"), (F.col("n") - 2).cast("double"))
    m = m.withColumn("s2", s2)
    slope_se = F.sqrt(F.try_divide(F.col("s2"), F.col("sxx")))
    icpt_se = F.sqrt(F.col("s2") * (1.0 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    out = m.select(*keys, "n", F.explode(F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("a").alias("estimate"), icpt_se.alias("se")),
        F.struct(F.lit(x).alias("term"), F.col("b").alias("estimate"), slope_se.alias("se")))).alias("r"))
    out = out.select(*keys, "n", "r.*").withColumn("t", F.try_divide("estimate", "se"))
    return out.select(*keys, "term", "estimate", "se", "t", student_tail("t", F.col("n") - 2).alias("p"), "n")


def lm_band(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 80, conf: float = 0.95) -> DataFrame:
    """Fitted line with a pointwise confidence band on an even grid of x."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("__cut", student_cut(F.lit((1 - conf) / 2), F.col("n") - 2))
    g = m.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    g = g.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / F.lit(points - 1.0))
    s2 = F.try_divide(F.col("syy") - F.col("b") * F.col("sxy"), (F.col("n") - 2).cast("double"))
    dx = F.col("x") - F.col("mx")
    g = g.withColumns({"fit": F.col("a") + F.col("b") * F.col("x"),
                       "se": F.sqrt(s2 * (1.0 / F.col("n") + F.try_divide(dx * dx, F.col("sxx"))))})
    return g.select(*keys, "step", "x", "fit", "se", (F.col("fit") - F.col("__cut") * F.col("se")).alias("lower"),
                    (F.col("fit") + F.col("__cut") * F.col("se")).alias("upper"))


def interaction_terms(df: DataFrame, x: str, category: str, levels: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Indicator and product columns against the first level.

    Returns the table, the main-effect terms and the interaction terms.
    """
    main, cross, new = [x], [], {}
    for lv in levels[1:]:
        hit = (F.col(category) == F.lit(lv)).cast("double")
        new[f"{category}{lv}"], new[f"{x}:{category}{lv}"] = hit, hit * F.col(x)
        main.append(f"{category}{lv}")
        cross.append(f"{x}:{category}{lv}")
    return df.withColumns(new), main, cross


def _moments(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    cols = [response, *terms]
    q = lambda c: F.col(f"`{c}`").cast("double")
    rows = df.select(*[q(c).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    cov = [F.covar_pop(f"c{i}", f"c{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"c{i}") for i in range(len(cols))]).alias("mean"),
                    F.array(*cov).alias("cov"))


def _solve(n: float, mean: np.ndarray, cov: np.ndarray, pick: list[int]):
    """Coefficients, standard errors and residual sum of squares from central moments."""
    k = len(pick)
    idx = [p + 1 for p in pick]
    sxx, sxy = cov[np.ix_(idx, idx)] * n, cov[idx, 0] * n
    inv = np.linalg.inv(sxx) if k else np.zeros((0, 0))
    b = inv @ sxy
    rss = float(cov[0, 0] * n - b @ sxy)
    df = n - k - 1
    s2 = rss / df
    mx = mean[idx]
    coef = np.concatenate([[mean[0] - b @ mx], b])
    se = np.sqrt(s2 * np.concatenate([[1.0 / n + mx @ inv @ mx], np.diag(inv)]))
    return coef, se, rss, df


def _unpack(pdf: pd.DataFrame, p: int):
    n, mean = float(pdf["n"][0]), np.asarray(pdf["mean"][0], dtype=float)
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = np.asarray(pdf["cov"][0], dtype=float)
    return n, mean, cov + np.triu(cov, 1).T


def linear_model(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    """Multiple regression: term, estimate, se, t, p, with the fit's n, rss, r squared."""
    terms = list(terms)

    def close(batches):
        for pdf in batches:
            n, mean, cov = _unpack(pdf, len(terms) + 1)
            coef, se, rss, df_r = _solve(n, mean, cov, list(range(len(terms))))
            t = coef / se
            yield pd.DataFrame({"term": ["(Intercept)", *terms], "estimate": coef, "se": se, "t": t,
                                "p": [student_p(v, df_r) for v in t], "n": int(n), "rss": rss,
                                "r_squared": 1.0 - rss / (cov[0, 0] * n)})

    return _moments(df, response, terms).mapInPandas(
        close, "term string, estimate double, se double, t double, p double, n bigint, rss double, r_squared double")


def nested_f(df: DataFrame, response: str, reduced: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """F test of a model against one with ``extra`` terms, both from one set of moments."""
    reduced, extra = list(reduced), list(extra)

    def close(batches):
        for pdf in batches:
            n, mean, cov = _unpack(pdf, len(reduced) + len(extra) + 1)
            _, _, rss0, df0 = _solve(n, mean, cov, list(range(len(reduced))))
            _, _, rss1, df1 = _solve(n, mean, cov, list(range(len(reduced) + len(extra))))
            f = ((rss0 - rss1) / (df0 - df1)) / (rss1 / df1)
            yield pd.DataFrame({"df_reduced": [int(df0)], "rss_reduced": [rss0], "df_full": [int(df1)],
                                "rss_full": [rss1], "f": [f], "p": [fisher_p(f, df0 - df1, df1)]})

    return _moments(df, response, reduced + extra).mapInPandas(
        close, "df_reduced bigint, rss_reduced double, df_full bigint, rss_full double, f double, p double")
