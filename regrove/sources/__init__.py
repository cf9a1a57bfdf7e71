"""Readers and writers for survey tables, rasters, points, polygons and stages."""

from .readers import (climate_bundle, csv_table, csv_tables, layer_stack, parquet_table, point_layer,
                      polygon_edges, raster_cells, stage)
from .writers import save_csv, save_raster, save_stage, site_list

__all__ = ["climate_bundle", "csv_table", "csv_tables", "layer_stack", "parquet_table", "point_layer",
           "polygon_edges", "raster_cells", "stage", "save_csv", "save_raster", "save_stage", "site_list"]
