"""Landscape jobs: terrain, severity, climate and soil predictors, rasters, grids.

Fixed values: the low-severity class limits and the two climate windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ecology import northeastness
from ..functions.projection import to_lat_lon
from ..operators import climate, raster, spatial
from ..operators.joins import natural_full, natural_left
from ..operators.reshape import column_range

LOW_SEVERITY = [(-250000, 288, 1), (288, 10000, None)]
CLIMATE_WINDOWS = {"short": (1990, 2019), "long": (1989, 2018)}


def climate_table(daily: DataFrame, windows: dict[str, tuple[int, int]] = CLIMATE_WINDOWS) -> DataFrame:
    """Seasonal normals and anomalies per site and scenario from daily weather."""
    yearly = climate.seasonal_means(climate.daily_deficit(daily), "site")
    return climate.normals_and_anomalies(yearly, windows, "site").withColumnRenamed("site", "plot_num")


def terrain_predictors(points: DataFrame, elevation: DataFrame, grid: raster.Grid) -> DataFrame:
    """Elevation, slope, north-eastness, position and ruggedness at points."""
    cells = raster.terrain(elevation, grid.res)
    got = raster.sample(points, cells, grid, ["value", "slope", "aspect", "tpi", "tri"])
    return got.withColumn("dev_ne", northeastness("aspect")).withColumnRenamed("value", "elev").drop("aspect")


def severity_predictors(points: DataFrame, severity: DataFrame, grid: raster.Grid) -> DataFrame:
    """Severity at points and distance to the nearest low-severity cell."""
    at = raster.sample(points, severity, grid).withColumnRenamed("value", "rdnbr")
    low = raster.to_points(raster.reclassify(severity, LOW_SEVERITY), grid).filter(F.col("value").isNotNull())
    low = low.select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    return spatial.nearest_feature(at, low, name="dist_unburned")


def soil_predictors(points: DataFrame, stacks: dict[str, tuple[DataFrame, raster.Grid]], zone: int = 12) -> DataFrame:
    """Layer means cropped to the points' surroundings and sampled in degrees."""
    lat, lon = to_lat_lon("x", "y", zone)
    out = points.withColumns({"__lon": lon, "__lat": lat})
    for name, (stack, grid) in stacks.items():
        mean = raster.layer_mean(stack)
        mean = raster.crop_to_points(mean, grid, out, 0.01, "__lon", "__lat")
        out = raster.sample(out, mean.withColumnRenamed("value", name), grid, [name], "__lon", "__lat")
    return out.drop("__lon", "__lat")


def soil_samples(soil: DataFrame, first: str = "pH", last: str = "TN") -> DataFrame:
    return soil.filter(F.col("plot_num").isNotNull()).select("plot_num", *column_range(soil, first, last))


def predictor_table(features: DataFrame, points: DataFrame, elevation, severity, daily: DataFrame, soil: DataFrame,
                    soil_stacks: dict, windows: dict[str, tuple[int, int]] = CLIMATE_WINDOWS) -> DataFrame:
    """Everything a model needs, keyed by plot number (never by row position)."""
    topo = terrain_predictors(points, *elevation).drop("x", "y")
    burn = severity_predictors(points, *severity).drop("x", "y")
    ground = soil_predictors(points, soil_stacks).drop("x", "y")
    out = natural_left(features, topo, ["plot_num"])
    out = natural_left(out, burn, ["plot_num"])
    out = natural_left(out, climate_table(daily, windows), ["plot_num", "season"])
    out = natural_full(out, soil_samples(soil), ["plot_num"])
    return natural_left(out, ground, ["plot_num"])


def severity_mosaic(layers: Sequence[tuple[DataFrame, DataFrame]], grid: raster.Grid, target: raster.Grid, to_source) -> DataFrame:
    """Each severity layer cut to its perimeter, merged by maximum, resampled."""
    cut = []
    for cells, edges in layers:
        box = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")),
                        F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
        cut.append(raster.mask(raster.crop(cells, grid, *box), edges, grid))
    return raster.resample(raster.mosaic(cut), grid, target, to_source)


def prediction_surface(elevation: DataFrame, grid: raster.Grid, severity: DataFrame, severity_grid: raster.Grid,
                       predictors: dict[str, DataFrame] | None = None) -> DataFrame:
    """Elevation cells within the severity raster's extent, with predictors by cell."""
    g = severity_grid
    extent = (g.xmin, g.xmin + g.ncol * g.res, g.ymax - g.nrow * g.res, g.ymax)
    return raster.prediction_grid(elevation, grid, extent, predictors)
