"""Count-model queries: item quantity per return flag stands in for seedling counts.

Two-parameter fits have SQL counterparts (Newton steps written as chained
common table expressions); larger model sets are rows only and are checked in
the tests against brute force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import hypothesis as hy, selection as sel, summaries as sm
from ..operators.glm import Model, count_checks, fit_models, likelihood_r2, overdispersion, with_null_models
from .base import R, out, query, read
from .statistics import _normal_p, _RANKS, _student_p

_FLAGS = ("A", "N", "R")


def _wide(spark):
    """The shared tables are single files: spread them over the cores once."""
    return {"min_partitions": spark.sparkContext.defaultParallelism}


def _design(spark, d):
    li = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("y"),
        F.log(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.log("l_extendedprice").alias("total"), F.col("l_linenumber").cast("double").alias("line"))
    return sm.z_scores(li, ["price", "disc", "tax", "total", "line"])


_DESIGN = """z AS (SELECT avg(ln(l_extendedprice / l_quantity)) AS pm, stddev_samp(ln(l_extendedprice / l_quantity)) AS ps FROM lineitem),
g AS (SELECT {key} AS g, l_quantity AS y, (ln(l_extendedprice / l_quantity) - pm) / ps AS x FROM lineitem, z)"""


def _chain(weight: str, key: str, steps: int = 12) -> str:
    """Fisher scoring for intercept and slope per group; ``weight`` scales the score by row."""
    parts = [_DESIGN.format(key=key), "b0 AS (SELECT g, ln(avg(y)) AS a, CAST(0 AS DOUBLE) AS b FROM g GROUP BY 1)"]
    for k in range(steps + 1):
        parts.append(f"m{k} AS (SELECT g.g, any_value(a) AS a, any_value(b) AS b, sum(w * mu) AS i0, sum(w * mu * x) AS i1, sum(w * mu * x * x) AS i2, sum(w * (y - mu)) AS s0,"
                     f" sum(w * (y - mu) * x) AS s1, sum((y - mu) * (y - mu) / (mu / w)) AS chi, count(*) AS n FROM (SELECT g.*, a, b, exp(a + b * x) AS mu, {weight} AS w FROM g JOIN b{k} USING (g)) g GROUP BY 1)")
        parts.append(f"b{k + 1} AS (SELECT g, a + (i2 * s0 - i1 * s1) / (i0 * i2 - i1 * i1) AS a, b + (i0 * s1 - i1 * s0) / (i0 * i2 - i1 * i1) AS b FROM m{k})")
    parts.append(f"fin AS (SELECT g, a, b, i2 / (i0 * i2 - i1 * i1) AS va, i0 / (i0 * i2 - i1 * i1) AS vb, chi, n FROM m{steps})")
    return ", ".join(parts)


_POIS = _chain("1.0", "l_linestatus")
_CROSSED = """a AS (SELECT * FROM fin WHERE g = 'F'), b AS (SELECT * FROM fin WHERE g = 'O'), tot AS (SELECT sum(chi) / (sum(n) - 4) AS disp, CAST(sum(n) - 4 AS DOUBLE) AS v FROM fin),
t AS (SELECT '(Intercept)' AS term, a.a AS e, a.va AS q FROM a UNION ALL SELECT 'price', a.b, a.vb FROM a
 UNION ALL SELECT 'l_linestatusO', b.a - a.a, a.va + b.va FROM a, b UNION ALL SELECT 'price:l_linestatusO', b.b - a.b, a.vb + b.vb FROM a, b)"""


def _crossed(spark, d, family="poisson"):
    from ..operators.regression import interaction_terms
    df, main, cross = interaction_terms(_design(spark, d), "price", "l_linestatus", ["F", "O"])
    return fit_models(df, [Model("crossed", "y", tuple(main + cross), family)], **_wide(spark))


@query(f"WITH {_POIS}, {_CROSSED} SELECT term, {R('e', 5)} AS estimate, {R('sqrt(q)', 5)} AS se, {R('e / sqrt(q)', 2)} AS stat, {R(_normal_p('(e / sqrt(q))'), 5)} AS p FROM t")
def poisson_glm(spark, d):
    return out(_crossed(spark, d).coefficients(), "term", "estimate", "se", "stat", "p", digits=5, stat=2)


@query(f"WITH {_POIS}, {_CROSSED} SELECT term, {R('e', 5)} AS estimate, {R('sqrt(q * disp)', 5)} AS se, {R('e / sqrt(q * disp)', 2)} AS stat,"
       f" {R(_student_p('(e / sqrt(q * disp))', 'v'), 5)} AS p FROM t, tot")
def quasipoisson_glm(spark, d):
    return out(_crossed(spark, d).coefficients(quasi=True), "term", "estimate", "se", "stat", "p", digits=5, stat=2)


@query(f"WITH {_POIS} SELECT {R('sum(chi)', 2)} AS pearson, CAST(sum(n) - 4 AS BIGINT) AS df_residual, {R('sum(chi) / (sum(n) - 4)', 5)} AS chat FROM fin")
def overdispersion_chat(spark, d):
    return out(overdispersion(_crossed(spark, d).summary()), "pearson", "df_residual", "chat", pearson=2, chat=5).withColumn(
        "df_residual", F.col("df_residual").cast("bigint"))


@query(f"""WITH {_chain('1 / (1 + exp(a + b * x))', 'l_returnflag', 14)}, t AS (SELECT g, '(Intercept)' AS term, a AS e, va AS q FROM fin UNION ALL SELECT g, 'price', b, vb FROM fin)
SELECT g AS model_group, term, {R('e', 5)} AS estimate, {R('sqrt(q)', 5)} AS se FROM t""")
def nb_glm_fixed(spark, d):
    fit = fit_models(_design(spark, d), [Model(f, "y", ("price",), theta=1.0, group=f) for f in _FLAGS], "l_returnflag", **_wide(spark))
    return out(fit.coefficients(), "model_group", "term", "estimate", "se", digits=5)


def _nb_chain(steps: int = 16) -> str:
    """Negative binomial with estimated theta: scoring for the line, Newton for log theta.

    The digamma differences are finite sums because counts are whole numbers.
    """
    parts = [_DESIGN.format(key="l_returnflag"), "h AS (SELECT g, y, count(*) AS c FROM g GROUP BY 1, 2)",
             "b0 AS (SELECT g, ln(avg(y)) AS a, CAST(0 AS DOUBLE) AS b, ln(avg(y) * avg(y) / (var_pop(y) - avg(y))) AS f FROM g GROUP BY 1)"]
    rows = ("SELECT g.*, a, b, f, exp(f) AS th, exp(a + b * x) AS mu FROM g JOIN b{k} USING (g)")
    moments = ("SELECT g, any_value(a) AS a, any_value(b) AS b, any_value(f) AS f, count(*) AS n, sum(mu * th / (mu + th)) AS i0, sum(mu * th / (mu + th) * x) AS i1,"
               " sum(mu * th / (mu + th) * x * x) AS i2, sum((y - mu) * th / (mu + th)) AS s0, sum((y - mu) * th / (mu + th) * x) AS s1,"
               " sum(-ln(1 + mu / th) + (mu - y) / (mu + th)) AS sr, sum(1 / th - 2 / (mu + th) + (y + th) / ((mu + th) * (mu + th))) AS hr,"
               " sum(mu * th * (y + th) / pow(mu + th, 2)) AS o0, sum(mu * th * (y + th) / pow(mu + th, 2) * x) AS o1, sum(mu * th * (y + th) / pow(mu + th, 2) * x * x) AS o2,"
               " sum(th * (y - mu) * mu / pow(mu + th, 2)) AS c0, sum(th * (y - mu) * mu / pow(mu + th, 2) * x) AS c1,"
               " sum(-th * ln(1 + mu / th) + y * (ln(mu) - ln(mu + th)) - lgamma(y + 1)) AS lr FROM ({rows}) GROUP BY 1")
    psi = ("SELECT g, sum(c * list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / (exp(f) + j)))) AS sp,"
           " -sum(c * list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / pow(exp(f) + j, 2)))) AS hp,"
           " sum(c * (lgamma(y + exp(f)) - lgamma(exp(f)))) AS lg FROM h JOIN b{k} USING (g) GROUP BY 1")
    for k in range(steps + 1):
        parts.append(f"b{k}m AS MATERIALIZED (SELECT * FROM b{k})")
        body = moments.format(rows=rows.format(k=f"{k}m"))
        parts.append(f"m{k} AS (SELECT m.*, sr + sp AS st, hr + hp AS ht, lr + lg AS ll FROM ({body}) m JOIN ({psi.format(k=f'{k}m')}) USING (g))")
        parts.append(f"b{k + 1} AS (SELECT g, a + (i2 * s0 - i1 * s1) / (i0 * i2 - i1 * i1) AS a, b + (i0 * s1 - i1 * s0) / (i0 * i2 - i1 * i1) AS b,"
                     f" f - greatest(-1.0, least(1.0, exp(f) * st / (exp(2 * f) * ht + exp(f) * st))) AS f FROM m{k})")
    parts.append(f"q AS (SELECT *, -(exp(2 * f) * ht + exp(f) * st) AS hf FROM m{steps})")
    parts.append("e AS (SELECT *, o0 - c0 * c0 / hf AS p0, o1 - c0 * c1 / hf AS p1, o2 - c1 * c1 / hf AS p2 FROM q)")
    parts.append("fin AS (SELECT g, a, b, exp(f) AS theta, ll, n, p2 / (p0 * p2 - p1 * p1) AS va, p0 / (p0 * p2 - p1 * p1) AS vb FROM e)")
    return ", ".join(parts)


_NB = _nb_chain()
_NB_TERMS = "t AS (SELECT g, '(Intercept)' AS term, a AS e, sqrt(va) AS s FROM fin UNION ALL SELECT g, 'price', b, sqrt(vb) FROM fin)"


def _by_flag(spark, d, terms=("price",)):
    return fit_models(_design(spark, d), with_null_models([Model(f, "y", tuple(terms), group=f) for f in _FLAGS]), "l_returnflag", **_wide(spark))


@query(f"WITH {_NB}, {_NB_TERMS} SELECT g AS model_group, term, {R('e', 4)} AS estimate, {R('s', 4)} AS se, {R('e / s', 1)} AS stat, {R(_normal_p('(e / s)'), 4)} AS p FROM t")
def nb_glm(spark, d):
    c = _by_flag(spark, d).coefficients().filter(~F.col("model_id").endswith("|null"))
    return out(c, "model_group", "term", "estimate", "se", "stat", "p", digits=4, stat=1)


def _null_theta(steps: int = 14) -> str:
    """Theta of the intercept-only model, whose mean is the sample mean."""
    parts = ["h0 AS (SELECT l_returnflag AS g, l_quantity AS y, count(*) AS c FROM lineitem GROUP BY 1, 2)",
             "mm AS (SELECT g, sum(c * y) / sum(c) AS mu, sum(c) AS n, sum(c * y * y) / sum(c) AS q FROM h0 GROUP BY 1)",
             "n0 AS (SELECT g, mu, ln(mu * mu / (q - mu * mu - mu)) AS f FROM mm)"]
    for k in range(steps):
        parts.append(f"k{k} AS (SELECT g, any_value(mu) AS mu, any_value(f) AS f, sum(c * (list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / (exp(f) + j))) - ln(1 + mu / exp(f)) + (mu - y) / (mu + exp(f)))) AS st,"
                     f" sum(c * (-list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / pow(exp(f) + j, 2))) + 1 / exp(f) - 2 / (mu + exp(f)) + (y + exp(f)) / pow(mu + exp(f), 2))) AS ht FROM h0 JOIN n{k} USING (g) GROUP BY 1)")
        parts.append(f"n{k + 1} AS (SELECT g, mu, f - exp(f) * st / (exp(2 * f) * ht + exp(f) * st) AS f FROM k{k})")
    parts.append(f"nul AS (SELECT g, sum(c * (lgamma(y + exp(f)) - lgamma(exp(f)) - lgamma(y + 1) - exp(f) * ln(1 + mu / exp(f)) + y * (ln(mu) - ln(mu + exp(f))))) AS ll0 FROM h0 JOIN n{steps} USING (g) GROUP BY 1)")
    return ", ".join(parts)


@query(f"""WITH {_NB}, {_null_theta()} SELECT g AS model_id, n, {R('ll', 1)} AS loglik, {R('ll0', 1)} AS loglik_null, {R('theta', 3)} AS theta,
 {R('(1 - exp(-2.0 / n * (ll - ll0))) / (1 - exp(2.0 / n * ll0))', 5)} AS r2 FROM fin JOIN nul USING (g)""")
def likelihood_ratio_r2(spark, d):
    return out(likelihood_r2(_by_flag(spark, d).summary()), "model_id", "n", "loglik", "loglik_null", "theta", "r2",
               loglik=1, loglik_null=1, theta=3, r2=5)


@query(f"""WITH {_NB}, {_NB_TERMS}, r AS (SELECT g, round(e, 4) AS e, round(s, 4) AS s FROM t WHERE term = 'price'),
c AS (SELECT *, CASE WHEN e < -0.4 THEN -0.4 WHEN e > 0.4 THEN 0.4 ELSE e END AS k FROM r)
SELECT g AS model_group, 'Size' AS term, 'Cost' AS type, 1 AS signif, {R('k', 4)} AS estimate,
 {R('CASE WHEN k - 1.96 * s < -0.4 THEN -1.4 ELSE k - 1.96 * s END', 4)} AS ci_min, {R('CASE WHEN k + 1.96 * s > 0.4 THEN 1.4 ELSE k + 1.96 * s END', 4)} AS ci_max FROM c""")
def effect_sizes(spark, d):
    c = _by_flag(spark, d).coefficients(4).filter(~F.col("model_id").endswith("|null"))
    e = sel.effect_table(c, {"price": "Cost"}, {"price": "Size"}, limit=0.4)
    return out(e, "model_group", "term", "type", "signif", "estimate", "ci_min", "ci_max", digits=4)


_TERMS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax", "unit"]


@query(f"""WITH {_RANKS}, v AS (SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax', 'unit']) AS name, unnest(range(5)) AS i),
s AS (SELECT unnest(range(1, 32)) AS subset), bad AS (SELECT (1 << a.i) | (1 << b.i) AS k FROM m JOIN v a ON a.name = m.var1 JOIN v b ON b.name = m.var2 WHERE abs(rho) > 0.5)
SELECT s.subset, CAST(bit_count(s.subset) AS INTEGER) AS size, (SELECT string_agg(name, ',' ORDER BY i) FROM v WHERE (s.subset >> i) & 1 = 1) AS terms
FROM s WHERE bit_count(s.subset) BETWEEN 1 AND 3 AND NOT EXISTS (SELECT 1 FROM bad WHERE s.subset & k = k)""")
def all_subsets(spark, d):
    li = read(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    mask = hy.independence_mask(hy.spearman_matrix(li, _TERMS))
    return sel.term_subsets(spark, _TERMS, 1, 3, mask)


_PREDICTORS = ["disc", "line", "price", "tax", "total"]


def _subset_fit(spark, d):
    df = _design(spark, d)
    mask = hy.independence_mask(hy.spearman_matrix(df, _PREDICTORS))
    return sel.fit_subsets(df, "y", sel.term_subsets(spark, _PREDICTORS, 1, 5, mask), group=_FLAGS, group_col="l_returnflag", **_wide(spark))


@query()
def subset_ranking(spark, d):
    r = sel.ranked_models(_subset_fit(spark, d).summary())
    return out(r, "model_group", "model_id", "terms", "k", "loglik", "aicc", "delta", "weight", digits=3)


@query()
def model_average(spark, d):
    fit = _subset_fit(spark, d)
    return out(sel.average_models(sel.ranked_models(fit.summary()), fit.coefficients()), "model_group", "term", "estimate", "se",
               "lower", "upper", "signif", "n_models", digits=4)


@query()
def averaged_effects(spark, d):
    fit = _subset_fit(spark, d)
    avg = sel.average_models(sel.ranked_models(fit.summary(), chat=1.2), fit.coefficients())
    kinds = {"price": "Cost", "total": "Cost", "disc": "Terms", "tax": "Terms"}
    return out(sel.averaged_table(avg, kinds, {"price": "Unit price", "total": "Line total"}), digits=4)


@query()
def partial_r2(spark, d):
    return out(sel.leave_one_out(_design(spark, d), Model("full", "y", ("price", "disc", "tax")), **_wide(spark)), digits=4)


@query()
def species_models(spark, d):
    fit = _by_flag(spark, d, ("price", "disc", "tax", "line"))
    c = fit.coefficients(4).filter(~F.col("model_id").endswith("|null"))
    return c.join(likelihood_r2(fit.summary()).select("model_id", F.round("r2", 4).alias("r2")), "model_id").select(
        "model_id", "term", "estimate", "se", "stat", "p", "r2")


@query()
def nb_checks(spark, d):
    df = _design(spark, d)
    fit = fit_models(df, [Model(f, "y", ("price",), group=f) for f in _FLAGS], "l_returnflag", **_wide(spark))
    checks = [count_checks(fit, df, f, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_returnflag", sims=100)
              for f in _FLAGS]
    return out(reduce(DataFrame.unionByName, checks), digits=4)
