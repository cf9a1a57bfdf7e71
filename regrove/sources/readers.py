"""Lazy readers.  A declared schema avoids a pass over the data to guess types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.joins import bind_rows
from ..operators.raster import Grid


def csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
              missing: str = "NA") -> DataFrame:
    """CSV with a header; ``missing`` marks nulls.  Types are guessed only without a schema.

    A schema binds columns by the names of the header, in any order; a column the file lacks and a value
    that does not parse are null.  All files under one path share a header.
    """
    r = spark.read.option("header", True).option("nullValue", missing)
    if schema is None:
        return r.option("inferSchema", True).csv(path)
    text = r.csv(path)      # the header line only: every column is a string
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    return text.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in text.columns
                          else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def csv_tables(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None,
               missing: str = "NA") -> DataFrame:
    """Several CSVs bound by column name; columns a file lacks are null."""
    return bind_rows([csv_table(spark, p, schema, missing) for p in paths])


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table saved by an earlier stage."""
    return spark.read.parquet(f"{folder}/{name}")


def layer_stack(spark: SparkSession, pattern: str, name: str = "layer") -> DataFrame:
    """All raster layers matching a glob, tagged by file or folder name."""
    df = spark.read.parquet(pattern) if "*" not in pattern else spark.read.option("pathGlobFilter", "*.parquet").parquet(pattern)
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.parquet)?(/part-[^/]*)?$", 1))


def point_layer(df: DataFrame, parts: Sequence[str], x: str = "x", y: str = "y", sep: str = "-") -> DataFrame:
    """Points with an id pasted from columns: ``plot_id, x, y``."""
    from ..functions.missing import paste
    return df.select(paste(*parts, sep=sep).alias("plot_id"), F.col(x).cast("double").alias("x"),
                     F.col(y).cast("double").alias("y"))


def polygon_edges(vertices: DataFrame, keys: Sequence[str] = ("poly_id", "ring"), seq: str = "seq") -> DataFrame:
    """Ring vertices to directed edges, each ring closed.

    The next vertex is met by an equi-join on position, so a long ring is not
    sorted in one task.
    """
    n = vertices.groupBy(*keys).agg(F.min(seq).alias("__first"), F.max(seq).alias("__last"))
    v = vertices.join(n, list(keys)).withColumn(
        "__next", F.when(F.col(seq) == F.col("__last"), F.col("__first")).otherwise(F.col(seq) + 1))
    nxt = vertices.select(*keys, F.col(seq).alias("__next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return v.join(nxt, [*keys, "__next"]).select(*keys, seq, F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def raster_cells(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cell table and grid written by ``save_raster``."""
    spec = spark.read.parquet(f"{path}/grid").first()
    return spark.read.parquet(f"{path}/cells"), Grid(spec["xmin"], spec["ymax"], spec["res"], spec["nrow"], spec["ncol"])


def climate_bundle(bundle: DataFrame, data: str = "data", site: str = "site", names: dict[str, str] | None = None) -> DataFrame:
    """Per-site arrays of daily records flattened to one row per site and day."""
    flat = bundle.select(site, F.explode(data).alias("d")).select(site, "d.*")
    return flat.withColumnsRenamed(names or {})
