"""Rasters as cell tables ``(layer..., row, col, value)`` on a declared grid.

Row 0 is the northern edge.  ``Grid`` is the one-row grid specification.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import classify, strict_mean
from .joins import natural_left

TILE = 256


@dataclass(frozen=True)
class Grid:
    xmin: float
    ymax: float
    res: float
    nrow: int
    ncol: int

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.xmin)) / F.lit(self.res)).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.ymax) - y) / F.lit(self.res)).cast("int")

    def x_of(self, col) -> Column:
        return F.lit(self.xmin) + (F.col(col) + F.lit(0.5)) * F.lit(self.res)

    def y_of(self, row) -> Column:
        return F.lit(self.ymax) - (F.col(row) + F.lit(0.5)) * F.lit(self.res)

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.nrow) & (col >= 0) & (col < self.ncol)


def neighbours(cells: DataFrame, value: str = "value", layer: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Each cell with its eight neighbours ``n00..n22`` (null where absent).

    Cells are copied to the square tiles they border (about 3 % extra at 256),
    so one exchange on the tile serves both window passes: first along rows for
    west/east, then along columns for the rows above and below.  A tile holds a
    fixed number of cells whatever the raster's size.
    """
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / F.lit(tile)).cast("int")
                                                for d in (-1, 0, 1)]))
    t = cells.select(*layer, "row", "col", F.col(value).cast("double").alias("v"))
    t = t.withColumn("__tr", F.explode(near("row"))).withColumn("__tc", F.explode(near("col")))
    tile_key = [*layer, "__tr", "__tc"]
    t = t.repartition(*tile_key)
    across = Window.partitionBy(*tile_key, "row").orderBy("col")

    def beside(step: int, w, pos: str, what: str) -> Column:
        shift = F.lead if step > 0 else F.lag
        return F.when(shift(pos).over(w) == F.col(pos) + step, shift(what).over(w))

    t = t.withColumns({"__w": beside(-1, across, "col", "v"), "__e": beside(1, across, "col", "v")})
    t = t.withColumn("__row3", F.struct(F.col("__w").alias("w"), F.col("v").alias("c"), F.col("__e").alias("e")))
    down = Window.partitionBy(*tile_key, "col").orderBy("row")
    t = t.withColumns({"__n": beside(-1, down, "row", "__row3"), "__s": beside(1, down, "row", "__row3")})
    own = (F.floor(F.col("row") / F.lit(tile)) == F.col("__tr")) & (F.floor(F.col("col") / F.lit(tile)) == F.col("__tc"))
    return t.filter(own).select(
        *layer, "row", "col", F.col("v").alias(value),
        F.col("__n.w").alias("n00"), F.col("__n.c").alias("n01"), F.col("__n.e").alias("n02"),
        F.col("__w").alias("n10"), F.col("__e").alias("n12"),
        F.col("__s.w").alias("n20"), F.col("__s.c").alias("n21"), F.col("__s.e").alias("n22"))


_RING = ["n00", "n01", "n02", "n10", "n12", "n20", "n21", "n22"]


def terrain(cells: DataFrame, res: float, value: str = "value", layer: Sequence[str] = (),
            tile: int = TILE) -> DataFrame:
    """Slope, aspect (degrees), topographic position and ruggedness per cell.

    Eight-neighbour weighted gradients; cells missing any neighbour get null.
    A flat cell's aspect is 90 by convention.
    """
    n = neighbours(cells, value, layer, tile)
    ring = [F.col(c) for c in _RING]
    whole = F.col(value).isNotNull()
    for c in ring:
        whole = whole & c.isNotNull()
    a, b, c, d, f, g, h, i = ring
    east = ((c + 2 * f + i) - (a + 2 * d + g)) / F.lit(8.0 * res)
    north = ((a + 2 * b + c) - (g + 2 * h + i)) / F.lit(8.0 * res)
    total = a + b + c + d + f + g + h + i
    rough = sum((F.abs(x - F.col(value)) for x in ring[1:]), F.abs(ring[0] - F.col(value)))
    n = n.withColumns({"__east": east, "__north": north})
    faces = F.degrees(F.atan2(-F.col("__east"), -F.col("__north")))
    aspect = F.when((F.col("__east") == 0) & (F.col("__north") == 0), F.lit(90.0)).when(
        faces < 0, faces + 360.0).otherwise(faces)
    steep = F.degrees(F.atan(F.sqrt(F.col("__east") * F.col("__east") + F.col("__north") * F.col("__north"))))
    return n.select(*layer, "row", "col", value,
                    F.when(whole, steep).alias("slope"), F.when(whole, aspect).alias("aspect"),
                    F.when(whole, F.col(value) - total / 8.0).alias("tpi"),
                    F.when(whole, rough / 8.0).alias("tri"))


def sample(points: DataFrame, cells: DataFrame, grid: Grid, values: Sequence[str] = ("value",),
           x: str = "x", y: str = "y") -> DataFrame:
    """Value of the cell under each point; null outside or where no cell exists.

    The raster is first reduced to the cells that hold a point.  Points are
    usually the small table: the semi join can then broadcast their cells, and
    the raster is not shuffled.
    """
    p = points.withColumns({"row": grid.row_of(F.col(y)), "col": grid.col_of(F.col(x))})
    asked = p.select("row", "col").filter(grid.inside(F.col("row"), F.col("col"))).distinct()
    c = cells.select("row", "col", *values).join(asked, ["row", "col"], "left_semi")
    return p.join(c, ["row", "col"], "left").drop("row", "col")


def reclassify(cells: DataFrame, classes, value: str = "value", into: str | None = None) -> DataFrame:
    """Right-closed interval classes; values in no class stay as they are."""
    return cells.withColumn(into or value, classify(value, classes))


def to_points(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """Centres of the cells that hold a value."""
    return cells.filter(F.col(value).isNotNull()).withColumns({"x": grid.x_of("col"), "y": grid.y_of("row")})


def crop(cells: DataFrame, grid: Grid, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Cells whose centres lie in a box.

    The box becomes row and column bounds, so the filter reaches the scan.
    """
    import math
    c0 = math.ceil((xmin - grid.xmin) / grid.res - 0.5)
    c1 = math.floor((xmax - grid.xmin) / grid.res - 0.5)
    r0 = math.ceil((grid.ymax - ymax) / grid.res - 0.5)
    r1 = math.floor((grid.ymax - ymin) / grid.res - 0.5)
    return cells.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def crop_to_points(cells: DataFrame, grid: Grid, points: DataFrame, buffer: float = 0.01,
                   x: str = "x", y: str = "y") -> DataFrame:
    """Crop to the points' extent grown by ``buffer`` (one four-number aggregate)."""
    e = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if e[0] is None:
        return cells.filter(F.lit(False))
    return crop(cells, grid, e[0] - buffer, e[1] + buffer, e[2] - buffer, e[3] + buffer)


def mask(cells: DataFrame, edges: DataFrame, grid: Grid, layer: Sequence[str] = (), polygon: str = "poly_id") -> DataFrame:
    """Cells whose centres fall inside any polygon of an edge table (holes are further rings of a polygon).

    Every edge yields its crossing x on each raster row it spans.  The sorted crossings of one polygon on
    one row bound intervals that lie inside; the columns of the intervals meet the cells by row and column.
    Polygons are told apart by ``polygon``, so overlapping ones add up.  Without that column all
    edges belong to one polygon.
    """
    of = [polygon] if polygon in edges.columns else []
    top = F.greatest("y1", "y2")
    low = F.least("y1", "y2")
    first = F.greatest(F.ceil((F.lit(grid.ymax) - top) / F.lit(grid.res) - 0.5).cast("int"), F.lit(0))
    last = F.least(F.floor((F.lit(grid.ymax) - low) / F.lit(grid.res) - 0.5).cast("int"), F.lit(grid.nrow - 1))
    spans = edges.filter(F.col("y1") != F.col("y2")).withColumns({"__a": first, "__b": last, "__lo": low, "__hi": top})
    spans = spans.filter(F.col("__a") <= F.col("__b")).withColumn("row", F.explode(F.sequence("__a", "__b")))
    cy = grid.y_of("row")
    spans = spans.filter((cy >= F.col("__lo")) & (cy < F.col("__hi")))
    cx = F.col("x1") + (cy - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = spans.select(*layer, *of, "row", cx.alias("__cx"))
    along = Window.partitionBy(*layer, *of, "row").orderBy("__cx")      # crossings of one polygon on one raster row
    runs = crossings.withColumns({"__n": F.row_number().over(along), "__end": F.lead("__cx").over(along)}).filter("__n % 2 = 1")
    # One column to spare on both sides; the centre itself decides.
    near = lambda c, by: (F.floor((F.col(c) - F.lit(grid.xmin)) / F.lit(grid.res)) + by).cast("int")
    a, b = F.greatest(near("__cx", -1), F.lit(0)), F.least(near("__end", 1), F.lit(grid.ncol - 1))
    inside = (runs.withColumns({"__a": a, "__b": b}).filter("__a <= __b").withColumn("col", F.explode(F.sequence("__a", "__b")))
              .withColumn("__x", grid.x_of("col")).filter((F.col("__x") >= F.col("__cx")) & (F.col("__x") < F.col("__end")))
              .select(*layer, "row", "col").distinct())
    return cells.join(inside, [*layer, "row", "col"], "left_semi").select(*cells.columns)


def mosaic(layers: Sequence[DataFrame], how=F.max, value: str = "value", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Merge overlapping rasters on one grid, cell by cell."""
    out = layers[0].select(*keys, value)
    for t in layers[1:]:
        out = out.unionByName(t.select(*keys, value))
    return out.groupBy(*keys).agg(how(value).alias(value))


def layer_mean(stack: DataFrame, value: str = "value", keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Mean of a stack's layers per cell; a missing layer value makes it missing."""
    return stack.groupBy(*keys).agg(strict_mean(value).alias(value))


def resample(cells: DataFrame, source: Grid, target: Grid, to_source, value: str = "value") -> DataFrame:
    """Bilinear resampling onto another grid.

    ``to_source(x, y)`` maps target coordinates to source coordinates as columns.
    Every target cell asks for its four surrounding source centres: one equi-join
    and one aggregation; a missing corner leaves the target cell missing.
    """
    spark = cells.sparkSession
    grid = spark.range(target.nrow * target.ncol).select(
        F.floor(F.col("id") / target.ncol).cast("int").alias("row"),
        (F.col("id") % target.ncol).cast("int").alias("col"))
    sx, sy = to_source(target.x_of("col"), target.y_of("row"))
    g = grid.withColumns({"__u": (sx - F.lit(source.xmin)) / F.lit(source.res) - 0.5,
                          "__v": (F.lit(source.ymax) - sy) / F.lit(source.res) - 0.5})
    g = g.withColumns({"__c": F.floor("__u").cast("int"), "__r": F.floor("__v").cast("int")})
    g = g.withColumns({"__fu": F.col("__u") - F.col("__c"), "__fv": F.col("__v") - F.col("__r")})
    corners = F.array(*[F.struct((F.col("__r") + dr).alias("sr"), (F.col("__c") + dc).alias("sc"),
                                 ((F.col("__fv") if dr else 1 - F.col("__fv"))
                                  * (F.col("__fu") if dc else 1 - F.col("__fu"))).alias("wt"))
                        for dr in (0, 1) for dc in (0, 1)])
    ask = g.select("row", "col", F.explode(corners).alias("k")).select("row", "col", "k.*").filter("wt > 0")
    src = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("__val"))
    got = ask.join(src, ["sr", "sc"], "left")
    whole = F.count("__val") == F.count(F.lit(1))
    return got.groupBy("row", "col").agg(F.when(whole, F.sum(F.col("wt") * F.col("__val"))).alias(value))


def prediction_grid(master: DataFrame, grid: Grid, extent: tuple[float, float, float, float],
                    predictors: dict[str, DataFrame] | None = None, value: str = "value") -> DataFrame:
    """Master cells with centres inside an extent, each predictor joined by cell."""
    out = to_points(crop(master, grid, *extent), grid, value)
    for name, layer in (predictors or {}).items():
        out = natural_left(out, layer.select("row", "col", F.col(value).alias(name)), ["row", "col"])
    return out
