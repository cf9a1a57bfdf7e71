"""Sinks: stage tables, CSV exports, rasters and the climate site list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame

from ..functions.projection import to_lat_lon
from ..operators.raster import Grid


def save_stage(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def save_csv(df: DataFrame, path: str, missing: str = "NA") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)


def save_raster(cells: DataFrame, grid: Grid, path: str) -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    spark = cells.sparkSession
    spark.createDataFrame([asdict(grid)], "xmin double, ymax double, res double, nrow int, ncol int").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/grid")


def site_list(points: DataFrame, site: str = "plot_num", x: str = "x", y: str = "y", zone: int = 12) -> DataFrame:
    """Projected points as ``site, lat, lon`` for a climate lookup."""
    lat, lon = to_lat_lon(x, y, zone)
    return points.select(points[site].alias("site"), lat.alias("lat"), lon.alias("lon"))
