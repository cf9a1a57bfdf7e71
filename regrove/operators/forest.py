"""Forest structure: species tables, importance, dominance, change and cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ecology as eco
from ..functions.missing import if_else, level_order, ratio, skip_sum, strict, strict_mean, strict_sum
from .grouping import dominant, tally
from .joins import complete_grid, natural_full
from .reshape import melt


def _strict_over(total, x: str, w) -> "F.Column":
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), total(x).over(w))


def with_importance(species: DataFrame, site: Sequence[str], count: str = "count",
                    basal: str = "basal") -> DataFrame:
    """Site totals and importance value beside each species row.

    ``species`` has one row per site and species, so a site window is bounded.
    """
    w = Window.partitionBy(*site)
    totals = species.withColumns({"site_basal": _strict_over(F.sum, basal, w),
                                  "site_count": F.sum(count).over(w)})
    return totals.withColumn("impval", eco.importance(count, "site_count", basal, "site_basal"))


def tree_structure(trees: DataFrame, keys: Sequence[str], species: str = "sp", n_quads: str = "n_quads",
                   dbh: str = "dbh", cones: str = "cones", serotinous: str = "serotinous",
                   plot_area: float = eco.PLOT_AREA_HA) -> DataFrame:
    """Per plot and species: stems, basal area, mean diameter, cones, density, importance."""
    t = trees.withColumn("__basal", eco.basal_area(dbh, n_quads, plot_area))
    g = t.groupBy(*keys, n_quads, species).agg(
        F.count(F.lit(1)).alias("count"), strict_sum("__basal").alias("basal"),
        F.avg(dbh).alias("dbh_mean"), skip_sum(F.col(cones).cast("int")).cast("bigint").alias("cones"),
        skip_sum(serotinous).alias("serot"))
    g = g.withColumn("dens_ha", eco.stem_density("count", n_quads, plot_area))
    return with_importance(g, [keys[0]])


def seedling_structure(seedlings: DataFrame, keys: Sequence[str], species: str = "sp",
                       count: str = "count", lengths: Sequence[str] = ("t1_length", "t2_length")) -> DataFrame:
    """Per plot and species: searched area, count, density and relative abundance."""
    s = seedlings.withColumns({"__n": F.coalesce(F.col(count).cast("double"), F.lit(0.0)),
                               "__area": eco.transect_area(*lengths)})
    s = s.withColumn("__dens", eco.per_hectare("__n", "__area"))
    g = s.groupBy(*keys, species).agg(strict_sum("__area").alias("area_m2"), F.sum("__n").alias("count"),
                                      strict_sum("__dens").alias("dens_ha"))
    w = Window.partitionBy(keys[0])  # one row per species and season of a plot
    g = g.withColumns({"basal": F.lit(0.0), "site_count": F.sum("count").over(w)})
    return g.withColumn("impval", ratio("count", "site_count", 0.0))


def cover_by_type(cover: DataFrame, keys: Sequence[str], kinds: Sequence[str], kind: str = "type",
                  value: str = "cover") -> DataFrame:
    """Mean cover of each type as columns; one missing quadrat makes the mean missing.

    One aggregation: the mean and the cast to wide share the shuffle on ``keys``.
    """
    out = []
    for k in kinds:
        hit = F.col(kind) == F.lit(k)
        known = F.count(F.when(hit, F.col(value)))
        out.append(F.when((known > 0) & (known == F.count_if(hit)),
                          F.avg(F.when(hit, F.col(value)))).alias(k))
    return cover.groupBy(*keys).agg(*out)


def totals_beside_species(rows: DataFrame, keys: Sequence[str], species: str,
                          sums: Sequence[str], total: str = "all") -> DataFrame:
    """Species sums plus an ``all`` row per key, in one grouping-sets pass."""
    sets = [[*keys, species], list(keys)]
    cols = [F.col(c) for c in (*keys, species)]
    agged = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.grouping(species).alias("__g"), *[skip_sum(c).alias(c) for c in sums])
    return agged.withColumn(species, F.when(F.col("__g") == 1, F.lit(total)).otherwise(
        F.col(species))).drop("__g")


def plot_features(pre: DataFrame, post: DataFrame, keys: Sequence[str], levels: Sequence[str],
                  species: str = "sp", serotinous_species: str | None = None) -> DataFrame:
    """One row per plot: species columns, totals and a binary serotiny flag.

    ``pre`` has ``basal, dens_ha, serot`` and ``post`` has ``dens_ha`` per species.
    Species columns and totals come from the same aggregation.
    """
    a = pre.groupBy(*keys, species).agg(F.avg("basal").alias("pre_basal"), F.avg("dens_ha").alias("pre_dens_ha"),
                                        F.avg("serot").alias("pre_serot"))
    b = post.groupBy(*keys, species).agg(F.avg("dens_ha").alias("post_dens_ha"))
    measures = ["pre_basal", "pre_dens_ha", "post_dens_ha"]
    both = natural_full(a, b, [*keys, species])
    both = both.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in [*measures, "pre_serot"]})
    aggs = []
    for m in measures:
        aggs += [F.coalesce(F.sum(F.when(F.col(species) == F.lit(s), F.col(m))), F.lit(0.0)).alias(f"{m}_{s}")
                 for s in levels]
        aggs.append(F.sum(m).alias(f"{m}_all"))
    if serotinous_species:
        cone = F.sum(F.when(F.col(species) == F.lit(serotinous_species), F.col("pre_serot")))
        aggs.append(F.when(F.coalesce(cone, F.lit(0.0)) > 0, 1).otherwise(0).alias("serot"))
    return both.groupBy(*keys).agg(*aggs)


def mark_empty(post: DataFrame, species: str = "sp", density: str = "dens_ha", empty: str = "None") -> DataFrame:
    """Rows with no seedlings stand for the empty state with density 1."""
    none = F.col(density) == 0
    return post.withColumns({species: if_else(none, F.lit(empty), F.col(species)),
                             density: if_else(none, F.lit(1.0), F.col(density))})


def dominance_change(pre: DataFrame, post: DataFrame, plot: Sequence[str], season: str = "season",
                     species: str = "sp") -> DataFrame:
    """Dominant species before and after, one row per plot and tie."""
    d0 = dominant(pre, plot, "impval").select(*plot, season, F.col(species).alias("pre_sp"))
    d1 = dominant(mark_empty(post, species), plot, "impval").select(
        *plot, season, F.col(species).alias("post_sp")).distinct()
    return natural_full(d0, d1, [*plot, season])


def flow_counts(change: DataFrame, season: str = "season") -> DataFrame:
    """Number of plots moving from each state to each state."""
    return tally(change, [season, "pre_sp", "post_sp"])


def dominance_table(change: DataFrame, plot: str, season: str, levels: Sequence[str]) -> DataFrame:
    """Plots by season, time and dominant state, with every plot shown at both times.

    Ties resolve to the first declared level; undeclared states are missing.
    """
    long = melt(change, [plot, season], ["pre_sp", "post_sp"], "time", "dom_sp")
    long = long.withColumn("dom_sp", F.when(F.col("dom_sp").isin(list(levels)), F.col("dom_sp")))
    full = complete_grid(long, plot, {"time": ["pre_sp", "post_sp"]})
    order = F.coalesce(level_order("dom_sp", levels), F.lit(len(levels) + 1))
    one = full.groupBy(plot, "time").agg(
        F.min_by(F.struct(season, "dom_sp"), F.struct(order, F.col(season))).alias("r"))
    return tally(one.select(plot, "time", "r.*"), [season, "time", "dom_sp"])


def species_shares_by_class(trees: DataFrame, plot: str, elev: str, species: str = "sp", n_quads: str = "n_quads",
                            dbh: str = "dbh", cones: str = "cones", serotinous: str = "serotinous",
                            plot_area: float = eco.PLOT_AREA_HA) -> DataFrame:
    """Species structure per plot with importance relative to the elevation class."""
    t = trees.withColumn("__b", eco.stem_basal_m2(dbh))
    g = t.groupBy(plot, elev, species).agg(
        F.count(F.lit(1)).alias("stems"), eco.surveyed_area(F.max(n_quads), plot_area).alias("area"),
        F.try_divide(skip_sum(serotinous), strict_sum(cones)).alias("serotiny"),
        strict_mean(dbh).alias("mean_dbh"), strict_mean("__b").alias("__mb"))
    g = g.withColumns({"density": F.try_divide(F.col("stems").cast("double"), F.col("area")),
                       "basal": F.try_divide(F.col("__mb"), F.col("area")),
                       "elev_class": eco.elevation_class(elev)}).drop("__mb")
    # A class spans many plots, so its totals are aggregated and joined back.
    from .grouping import with_group
    g = with_group(g, ["elev_class"], __cb=strict(F.sum("basal"), "basal"), site_area=F.max("area"),
                   site_stems=F.sum("stems"), site_density=strict_sum("density"))
    g = g.withColumn("site_basal", F.try_divide(F.col("__cb"), F.col("site_area"))).drop("__cb")
    return g.withColumn("impval", eco.importance("stems", "site_stems", "basal", "site_basal"))


def merge_split_trees(records: DataFrame, keys: Sequence[str], order: str, species: str = "sp",
                      cones: str = "cones", dbh: str = "dbh", serotinous: str = "serotinous") -> DataFrame:
    """One row per tree from split records; a tree without cones has no serotiny."""
    g = records.groupBy(*keys).agg(F.min_by(species, order).alias(species), F.max(cones).alias(cones),
                                   F.max(dbh).alias(dbh), F.max(serotinous).alias(serotinous))
    g = g.withColumn(cones, F.coalesce(cones, F.lit(0)))
    return g.withColumn(serotinous, F.when(F.col(cones) == 0, F.lit(None))
                        .when((F.col(cones) == 1) & F.col(serotinous).isNull(), F.lit(0))
                        .otherwise(F.col(serotinous)))
