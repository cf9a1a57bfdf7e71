"""All-subsets model selection, averaging and displayed effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ecology import excludes_zero, normal_interval, significant
from ..functions.missing import clamp, label
from .glm import Fit, Model, fit_models, with_null_models
from .joins import natural_left

CODE_BITS = 62      # a subset is coded as one bit per term in a BIGINT


def term_subsets(spark: SparkSession, terms: Sequence[str], min_terms: int = 1, max_terms: int = 5,
                 mask: DataFrame | None = None) -> DataFrame:
    """Every allowed subset: ``subset`` (bit code), ``size``, ``terms``.

    ``mask`` has ``var1, var2, allowed``; subsets holding a forbidden pair are
    filtered by bit tests before any model is fitted.
    """
    terms = list(terms)
    if len(terms) > CODE_BITS:
        raise ValueError(f"a subset code holds at most {CODE_BITS} terms")
    bad: set[tuple[int, int]] = set()
    if mask is not None:
        for a, b in mask.filter(~F.col("allowed")).select("var1", "var2").collect():  # at most p(p-1)/2 rows
            if a in terms and b in terms:
                bad.add(tuple(sorted((terms.index(a), terms.index(b)))))
    # Sizes grow from the allowed subsets one term smaller, so forbidden pairs prune early.
    rows, level = [], [()]
    for size in range(1, min(max_terms, len(terms)) + 1):
        level = [(*c, i) for c in level for i in range(c[-1] + 1 if c else 0, len(terms)) if not any((j, i) in bad for j in c)]
        if size >= min_terms:
            rows += [(sum(1 << i for i in c), size, ",".join(terms[i] for i in c)) for c in level]
    return spark.createDataFrame(sorted(rows), "subset bigint, size int, terms string")


def fit_subsets(df: DataFrame, response: str | Sequence[str], subsets: DataFrame, family: str = "negbin",
                theta: float | None = None, group: str | Sequence[str] | None = None, group_col: str | None = None,
                **options) -> Fit:
    """Fit one model per response, group and subset in shared passes; the id is ``<group or response>#<bit code>``.

    Rows of other groups are filtered in the scan, before any batch leaves the engine.
    """
    rows = subsets.select("subset", "terms").orderBy("subset").collect()  # the models to fit
    responses = [response] if isinstance(response, str) else list(response)
    groups = [group] if group is None or isinstance(group, str) else list(group)
    models = [Model(f"{g or r}#{row['subset']}", r, tuple(row["terms"].split(",")), family, theta, g)
              for r in responses for g in groups for row in rows]
    if group is not None:
        df = df.filter(F.col(group_col).isin(groups))
    return fit_models(df, models, group_col, **options)


def ranked_models(summary: DataFrame, chat: float | dict[str, float] | None = None) -> DataFrame:
    """Models by information criterion with delta and weight within response and group.

    With ``chat`` (a number, or one per response) the criterion is the quasi form corrected for
    dispersion.  Every model stays: one
    without a likelihood has a null criterion and weight, others keep their ``status``.
    """
    keys = ["response", "model_group"]
    s = summary.filter(~F.col("model_id").endswith("|null"))
    if chat is None:
        s = s.withColumn("ic", F.col("aicc"))
    else:
        by = F.lit(float(chat)) if not isinstance(chat, dict) else F.element_at(
            F.create_map(*[F.lit(v) for r, c in chat.items() for v in (r, float(c))]), F.col("response"))
        s = s.withColumn("ic", -2 * F.col("loglik") / by + 2 * (F.col("k") + 1))
    s = natural_left(s, s.groupBy(*keys).agg(F.min("ic").alias("__best")), keys)
    s = s.withColumn("delta", F.col("ic") - F.col("__best")).drop("__best")
    s = s.withColumn("__e", F.exp(-F.col("delta") / 2))
    s = natural_left(s, s.groupBy(*keys).agg(F.sum("__e").alias("__t")), keys)
    return s.withColumn("weight", F.col("__e") / F.col("__t")).drop("__e", "__t")


def average_models(ranked: DataFrame, coefs: DataFrame, delta: float = 2.0) -> DataFrame:
    """Conditional average of the models within ``delta`` of the best.

    Each term is averaged over the kept models that hold it; the standard error
    adds between-model spread.  A single kept model gives its own estimates.
    """
    keys = ["response", "model_group"]
    top = ranked.filter(F.col("delta") <= delta).select("model_id", "weight")
    c = coefs.join(top, "model_id")
    m = c.groupBy(*keys, "term").agg((F.sum(F.col("weight") * F.col("estimate")) / F.sum("weight")).alias("avg"),
                                     F.sum("weight").alias("tw"), F.count(F.lit(1)).alias("n_models"))
    c = natural_left(c, m, [*keys, "term"])
    spread = F.col("weight") * (F.col("se") * F.col("se") + (F.col("estimate") - F.col("avg")) * (F.col("estimate") - F.col("avg")))
    out = c.groupBy(*keys, "term").agg(F.first("avg").alias("estimate"), F.sqrt(F.sum(spread) / F.first("tw")).alias("se"),
                                       F.first("n_models").alias("n_models"))
    lo, hi = normal_interval("estimate", "se", 1.959963984540054)
    out = out.withColumns({"lower": lo, "upper": hi})
    return out.withColumn("signif", excludes_zero("lower", "upper"))


def leave_one_out(df: DataFrame, model: Model, group_col: str | None = None, **options) -> DataFrame:
    """Drop in R squared when each term is left out of the model."""
    from .glm import likelihood_r2
    less = [Model(f"{model.id}-{t}", model.response, tuple(x for x in model.terms if x != t), model.family, model.theta,
                  model.group) for t in model.terms]
    r2 = likelihood_r2(fit_models(df, with_null_models([model, *less]), group_col, **options).summary())
    whole = r2.filter(F.col("model_id") == model.id).select(F.col("r2").alias("r2_full"), F.lit(1).alias("__k"))
    part = r2.filter(F.col("model_id") != model.id).select(
        F.expr(f"substring(model_id, {len(model.id) + 2})").alias("term"), F.col("r2").alias("r2_without"), F.lit(1).alias("__k"))
    return part.join(whole, "__k").select("term", "r2_full", "r2_without",
                                          (F.col("r2_full") - F.col("r2_without")).alias("partial_r2"))


def effect_table(coefs: DataFrame, kinds: dict[str, str], labels: dict[str, str] | None = None,
                 limit: float = 10.0, level: float = 0.05, z: float = 1.96) -> DataFrame:
    """Display table: intercept dropped, flagged, typed, relabelled and clamped.

    Estimates are clamped to the limit first and intervals follow the clamped
    value; interval ends beyond the limit are drawn one unit outside it.
    """
    out = coefs.filter(F.col("term") != "(Intercept)").withColumn("signif", significant("p", level))
    kind = None
    for t, k in kinds.items():
        kind = (F if kind is None else kind).when(F.col("term") == F.lit(t), F.lit(k))
    out = out.withColumns({"type": kind, "estimate": clamp("estimate", -limit, limit)})
    lo, hi = normal_interval("estimate", "se", z)
    out = out.withColumns({"ci_min": F.when(lo < -limit, F.lit(-limit - 1)).otherwise(lo),
                           "ci_max": F.when(hi > limit, F.lit(limit + 1)).otherwise(hi)})
    if labels:
        out = out.withColumn("term", label("term", list(labels), list(labels.values())))
    return out


def averaged_table(averages: DataFrame, kinds: dict[str, str], labels: dict[str, str] | None = None) -> DataFrame:
    """Averaged effects for display: typed, relabelled, numbered by falling estimate.

    One row per model term, so the ordering window is small.
    """
    out = averages.filter(F.col("term") != "(Intercept)")
    kind = None
    for t, k in kinds.items():
        kind = (F if kind is None else kind).when(F.col("term") == F.lit(t), F.lit(k))
    order = Window.partitionBy("response", "model_group").orderBy(F.col("estimate").desc(), "term")
    out = out.withColumns({"type": kind, "ord": F.row_number().over(order)})
    name = F.col("term")
    for t, text in (labels or {}).items():
        name = F.when(F.col("term") == F.lit(t), F.lit(text)).otherwise(name)
    return out.select("response", "model_group", name.alias("predictor"), "estimate", "lower", "upper", "signif", "type", "ord")
