"""Field-survey jobs: plots, structure tables, cover, features, dominance, seedlings.

Fixed values: column prefixes of the survey form, the species list, the recode
of unnamed trees, height classes and name prefixes of the seedling tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import ecology as eco
from ..functions.missing import collapse, not_member, paste, recode, row_mean, to_number
from ..operators import forest
from ..operators.grouping import dominant, first_per_key, group_index, group_maximum, number_rows
from ..operators.joins import bind_rows, natural_full
from ..operators.reshape import matching, melt_parts, melt_records, numeric_means

SPECIES = ["PICO", "PSME", "LAOC", "TSHE", "THPL", "PIEN", "ABLA", "POTR"]
DOMINANT_LEVELS = ["PIEN", "ABLA", "PICO", "LAOC", "PSME", "TSHE", "THPL", "POTR", "None"]
COVER_TYPES = ["forb", "gram", "shrub", "tree", "total"]
UNNAMED = ("other", "THPL")
EXCLUDED = ["ACGL", "ALVI", "JUCO", "POTR", "POBA", "TABR", "BEPA"]
SPECIES_GROUPS = {"DECID": ["BEPA", "ACGL", "ACOC"], "CDHM": ["TSHE", "THPL"], "SPFR": ["ABGR", "PIEN", "ABLA"]}


def plots_with_points(points: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits matched to points, numbered, one row per location.

    Numbers are given before duplicates are removed, so they may have gaps.
    """
    both = natural_full(points, visits.withColumn("plot_id", paste("name", "today", sep="-")), ["plot_id"])
    kept = both.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("plot_id") != "NA-NA"))
    numbered = number_rows(kept.drop("name", "today"), ["plot_id", "season", "x", "y"], "plot_num")
    return first_per_key(numbered, ["x", "y"], ["plot_num"])


def plot_info(plots: DataFrame) -> DataFrame:
    """Plot-level columns with mean canopy and coordinates."""
    keep = matching(plots, prefixes=["phys", "seeds"])
    return plots.select("plot_num", "plot_id", *keep,
                        row_mean("canopy_1", "canopy_2", "canopy_3", "canopy_4").alias("canopy"),
                        F.col("x").alias("utm_x"), F.col("y").alias("utm_y"))


def prefire_trees(plots: DataFrame) -> DataFrame:
    """One row per measured tree from the wide form."""
    cols = [c for c in matching(plots, prefixes=["prefire"], exclude_contains=["note"]) if c != "prefire_n_quads"]
    trees = melt_records(plots, ["plot_num", "season", "prefire_n_quads"], cols, ["type", "quad", "num", "att"], "att")
    trees = trees.filter(F.col("dbh").isNotNull())
    return trees.withColumns({"dbh": to_number("dbh"), "cones": to_number("cones"),
                              "serotinous": to_number("serotinous"), "sp": recode("sp", *UNNAMED)})


def prefire_structure(plots: DataFrame) -> DataFrame:
    s = forest.tree_structure(prefire_trees(plots), ["plot_num", "season"], n_quads="prefire_n_quads")
    return s.select(F.lit("prefire").alias("time"), "plot_num", "season", "sp", "basal", "dbh_mean", "cones", "serot",
                    "dens_ha", "impval")


def postfire_structure(plots: DataFrame) -> DataFrame:
    cols = matching(plots, prefixes=["seedlings"], exclude_contains=["length", "header", "note", "end"])
    ids = ["plot_num", "season", "seedlings_t1_length", "seedlings_t2_length"]
    long = melt_parts(plots, ids, cols, [None, "transect", "age", "sp"], values_to="count", value_type="double")
    s = forest.seedling_structure(long.filter(F.col("sp") != "other"), ["plot_num", "season"],
                                  lengths=("seedlings_t1_length", "seedlings_t2_length"))
    return s.select(F.lit("postfire").alias("time"), "plot_num", "season", "sp", "dens_ha", "basal", "impval")


def understory_cover(plots: DataFrame, kinds: Sequence[str] = COVER_TYPES) -> DataFrame:
    cols = matching(plots, prefixes=["vegcover"], exclude_contains=["note"])
    long = melt_parts(plots, ["plot_num", "plot_id", "season"], cols, [None, "tran", "quad", "type"], values_to="cover",
                      value_type="double")
    return forest.cover_by_type(long, ["plot_num", "plot_id", "season"], kinds)


def plot_features(pre: DataFrame, post: DataFrame, info: DataFrame, cover: DataFrame,
                  species: Sequence[str] = SPECIES) -> DataFrame:
    wide = forest.plot_features(pre, post, ["plot_num", "season"], species, serotinous_species="PICO")
    extra = info.select("plot_num", "canopy", F.col("seeds_dist_cone").alias("seeds"))
    return natural_full(natural_full(wide, extra, ["plot_num"]), cover, ["plot_num", "season"])


def dominance(pre: DataFrame, post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change table (pre and post dominant species) and its exported tally."""
    change = forest.dominance_change(pre, post, ["plot_num"])
    return change, forest.dominance_table(change, "plot_num", "season", DOMINANT_LEVELS)


def elevation_dominance(records: DataFrame) -> DataFrame:
    """Dominant species group of each plot from split tree records of several files.

    ``records``: plot_name, elev, n_quads, quad, tree, part, sp, cones, dbh, serotinous.
    """
    keys = ["plot_name", "elev", "n_quads", "quad", "tree"]
    trees = forest.merge_split_trees(records, keys, "part")
    trees = trees.withColumn("sp", collapse("sp", SPECIES_GROUPS)).filter(F.col("sp").isNotNull())
    shares = forest.species_shares_by_class(trees, "plot_name", "elev")
    return dominant(shares, ["plot_name"], "impval")


def seedlings_survey_a(plots: DataFrame) -> DataFrame:
    """Initial seedlings of the transect survey (wide dotted export)."""
    cols = matching(plots, prefixes=["seedlings"], exclude_contains=["length", "header", "other", "end"])
    ids = ["plot.utm_easting", "plot.utm_northing", "plot.name", "phys.phys_elev",
           "seedlings_t1.seedlings_t1_length", "seedlings_t2.seedlings_t2_length"]
    long = melt_parts(plots, ids, cols, [None, None, None, None, "transect", "year", "sp"], value_type="double")
    a, b = F.col("`seedlings_t1.seedlings_t1_length`"), F.col("`seedlings_t2.seedlings_t2_length`")
    default = F.lit(float(eco.TRANSECT_LENGTH_M))
    long = long.select(F.col("`plot.utm_easting`").alias("easting"), F.col("`plot.utm_northing`").alias("northing"),
                       F.col("`plot.name`").alias("name"), F.col("`phys.phys_elev`").alias("elev"), "year", "sp",
                       (F.coalesce(a, default) + F.coalesce(b, default)).alias("length"),
                       F.coalesce(F.col("value"), F.lit(0.0)).alias("n"))
    g = long.groupBy("easting", "northing", "name", "elev", "year", "sp", "length").agg(F.sum("n").alias("n"))
    g = g.select("easting", "northing", F.col("name"), F.col("sp").alias("species"),
                 F.when(F.col("year") == "age1", 1).otherwise(2).alias("age"),
                 eco.per_hectare("n", F.col("length") * eco.TRANSECT_WIDTH_M).alias("count"))
    g = group_index(g, ["name"], "stand_id")
    top = group_maximum(g, ["stand_id", "species", "age"], "count")
    return top.select(paste(F.lit("TH-"), "name").alias("plot_name"), "easting", "northing", "stand_id", "species",
                      F.bround("count", 0).alias("count"), "age",
                      F.when(F.col("age") == 1, 0.02).otherwise(0.08).alias("height_from"),
                      F.when(F.col("age") == 1, 0.05).otherwise(0.15).alias("height_to"))


def seedlings_survey_b(counts: DataFrame, sites: DataFrame, after: DataFrame) -> DataFrame:
    """Initial seedlings of the belt survey; stands are numbered after ``after``'s."""
    c = counts.filter(F.col("count") > 0).withColumn("count_ha", eco.belt_density("count", "width"))
    top = group_maximum(c, ["fire", "plot", "species"], "count_ha").filter(not_member("species", EXCLUDED))
    top = group_index(top, ["fire", "plot"], "stand_id", after.agg(F.max("stand_id")))
    top = top.select(F.upper(paste("fire", "plot")).alias("plot_name"), "stand_id", "species",
                     F.col("count_ha").alias("count"), F.when(F.col("fire") == "RE06", 1).otherwise(3).alias("age"))
    top = top.withColumns({"height_from": F.when(F.col("age") == 1, 0.02).otherwise(0.1),
                           "height_to": F.when(F.col("age") == 1, 0.05).otherwise(0.3)})
    where = sites.withColumn("plot_name", F.expr("substr(plot_name, 1, length(plot_name) - 1)"))
    where = numeric_means(where, ["plot_name"]).select("plot_name", F.bround("easting", 0).alias("easting"),
                                                       F.bround("northing", 0).alias("northing"))
    full = natural_full(top, where, ["plot_name"]).withColumn("plot_name", paste(F.lit("DM-"), "plot_name"))
    return full.select("plot_name", "easting", "northing", "stand_id", "species", "count", "age", "height_from", "height_to")


def seedling_tables(survey_a: DataFrame, survey_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Simulator key table and initial-state table over both surveys."""
    both = bind_rows([survey_a, survey_b]).withColumnRenamed("stand_id", "env_id")
    full = number_rows(both, ["env_id", "species", "age", "plot_name", "easting", "northing", "count"], "stand_id")
    return (full.select("env_id", "stand_id", "easting", "northing", "species", "plot_name"),
            full.select("stand_id", "species", "count", "height_from", "height_to", "age"))
