"""Modelling jobs: composition change, structure comparison, species models.

Fixed values: the modelled species, their shared predictors and effect labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import community, hypothesis, regression, selection, summaries
from ..operators.glm import Fit, Model, fit_models, likelihood_r2, overdispersion, with_null_models
from ..operators.joins import natural_full, natural_left
from ..operators.reshape import matching, melt
from .survey import SPECIES

MODELLED = ["LAOC", "PICO", "PSME", "PIEN", "ABLA", "TSHE"]
SHARED_TERMS = ["dist_unburned", "vpd", "dev_ne", "OM"]
GLOBAL_TERMS = ["pre_basal_all", "dist_unburned", "tmax", "vpd", "dev_ne", "tpi", "OM"]
EFFECT_TYPES = {"serot_BA": "Seed sources", "dist_unburned": "Seed sources", "canopy": "Microclimate",
                "vpd": "Microclimate", "dev_ne": "Microclimate", "OM": "Soil"}
EFFECT_LABELS = {"OM": "Soil OM", "serot_BA": "Serotiny or BA", "dist_unburned": "Dist. low sev.", "vpd": "VPD",
                 "dev_ne": "Aspect", "canopy": "Dead canopy"}


@dataclass
class Composition:
    dissimilarity: DataFrame
    by_season: DataFrame
    anova: DataFrame
    ordination: DataFrame
    centroids: DataFrame
    species: DataFrame
    anosim: DataFrame


def composition_change(pre: DataFrame, post: DataFrame, species: Sequence[str] = SPECIES, permutations: int = 999,
                       starts: int = 50) -> Composition:
    """Dissimilarity between visits, ordination and group separation."""
    cols = ["season", "plot_num", "time", "sp", "dens_ha"]
    rows = pre.select(*cols).unionByName(post.select(*cols))
    bray = community.change_dissimilarity(rows, ["season", "plot_num"], "time", "prefire", "postfire", "sp", species, "dens_ha")
    sites = community.site_patterns(rows, ["season", "time", "plot_num"], "sp", species, "dens_ha")
    sites = sites.withColumn("group", F.concat_ws("_", "season", "time"))
    ordn = community.nmds(sites, starts=starts)
    return Composition(bray, summaries.median_and_se(bray, ["season"], ["bray"]), hypothesis.anova(bray, [], "season", "bray"),
                       ordn, community.group_centroids(community.site_scores(sites, ordn), ["group"]),
                       community.species_scores(ordn, species), community.anosim(sites, "group", permutations))


def plot_densities(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Total density before and after per plot."""
    a = pre.groupBy("plot_num", "season").agg(F.sum("dens_ha").alias("pre_dens"))
    b = post.groupBy("plot_num", "season").agg(F.sum("dens_ha").alias("post_dens"))
    return natural_full(a, b, ["plot_num", "season"])


def density_comparison(plots: DataFrame) -> dict[str, DataFrame]:
    """Medians, two-sample tests and the pre-post relation, by season."""
    long = melt(plots, ["season"], ["pre_dens", "post_dens"], "time", "dens")
    logs = plots.filter("post_dens > 0 and pre_dens > 0").select(
        "season", F.log10("pre_dens").alias("log_pre"), F.log10("post_dens").alias("log_post"))
    floor = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    safe = plots.select("season", F.log(floor("pre_dens")).alias("pre"), F.log(floor("post_dens")).alias("post"))
    return {"medians": summaries.median_and_se(plots, ["season"], ["pre_dens", "post_dens"]),
            "median_test": hypothesis.median_test(long, ["season"], "time", "dens"),
            "ks": hypothesis.ks_two_sample(long, ["season"], "time", "dens", "pre_dens", "post_dens"),
            "histogram": summaries.log_histogram(long, ["season", "time"], "dens"),
            "line": regression.simple_lm(logs, ["season"], "log_pre", "log_post"),
            "band": regression.lm_band(logs, ["season"], "log_pre", "log_post"),
            "correlation": hypothesis.pearson(safe, ["season"], "pre", "post"),
            "correlation_raw": hypothesis.pearson(plots, ["season"], "pre_dens", "post_dens")}


def cover_comparison(features: DataFrame, kinds: Sequence[str] = ("forb", "gram", "shrub", "total"),
                     reps: int = 1000) -> dict[str, DataFrame]:
    """Cover by type between seasons: tests, letters and bootstrap limits."""
    long = melt(features, ["plot_num", "season"], list(kinds), "type", "pct", "double")
    letters = hypothesis.letters(long, ["type"], "season", "pct")
    boot = hypothesis.bootstrap_mean(long, ["season", "type"], "pct", ["plot_num", "season", "type"], reps)
    return {"anova": hypothesis.anova(long, ["type"], "season", "pct"), "tukey": hypothesis.tukey(long, ["type"], "season", "pct"),
            "box": summaries.box_stats(long, ["type", "season"], "pct"),
            "means": natural_left(boot, letters, ["type", "season"])}


def scaled_design(model_table: DataFrame, extra: Sequence[str] = ("dist_unburned", "serot", "canopy", "dev_ne", "tmax", "vpd", "OM", "clay"),
                  complete: str = "pH") -> DataFrame:
    """Rounded responses and standardised predictors of plots with soil data."""
    post = matching(model_table, contains=["post_dens"])
    pred = [*matching(model_table, contains=["pre_basal"]), *extra]
    rows = model_table.filter(F.col(complete).isNotNull()).select("plot_num", *post, *pred)
    scaled = summaries.z_scores(rows, pred)
    return scaled.withColumns({c: F.bround(c, 0) for c in post})


def species_models(design: DataFrame, species: Sequence[str] = MODELLED) -> tuple[Fit, DataFrame, DataFrame]:
    """One negative-binomial model per species, all fitted together.

    Returns the fit, the coefficient table (rounded, with R squared) and effects.
    """
    models = [Model(sp, f"post_dens_ha_{sp}", ("serot" if sp == "PICO" else f"pre_basal_{sp}", *SHARED_TERMS)) for sp in species]
    fit = fit_models(design, with_null_models(models))
    r2 = likelihood_r2(fit.summary()).select("model_id", "r2")
    coefs = fit.coefficients(4).filter(~F.col("model_id").endswith("|null")).join(r2, "model_id")
    coefs = coefs.withColumnRenamed("model_id", "species").withColumn(
        "term", F.when(F.col("term") == F.concat(F.lit("pre_basal_"), "species"), F.lit("prefire_BA_sp")).otherwise(F.col("term")))
    shown = coefs.withColumn("term", F.when(F.col("term").isin("serot", "prefire_BA_sp"), F.lit("serot_BA")).otherwise(F.col("term")))
    return fit, coefs, selection.effect_table(shown, EFFECT_TYPES, EFFECT_LABELS)


def averaged_effects(design: DataFrame, species: Sequence[str] = MODELLED, terms: Sequence[str] = GLOBAL_TERMS,
                     max_terms: int = 5, limit: float = 0.5, quasi: bool = False) -> DataFrame:
    """All-subsets selection per species and the conditional average of the best models."""
    mask = hypothesis.independence_mask(hypothesis.spearman_matrix(design, terms), limit)
    subsets = selection.term_subsets(design.sparkSession, terms, 1, max_terms, mask)
    responses = {f"post_dens_ha_{sp}": sp for sp in species}
    fit = selection.fit_subsets(design, list(responses), subsets)       # all species share every pass
    chat = None
    if quasi:
        whole = fit_models(design, [Model(f"{sp}-global", r, tuple(terms)) for r, sp in responses.items()])
        named = overdispersion(whole.summary()).collect()               # one row per species
        chat = {r: next(x["chat"] for x in named if x["model_id"] == f"{sp}-global") for r, sp in responses.items()}
    avg = selection.average_models(selection.ranked_models(fit.summary(), chat), fit.coefficients())
    return avg.withColumn("species", F.regexp_replace("response", "^post_dens_ha_", ""))
