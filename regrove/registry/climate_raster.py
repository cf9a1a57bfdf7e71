"""Climate, raster and distance queries.

Line items stand in for daily weather (supplier = site), parts for a 50-column
elevation grid of 100 m cells, customers for points.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import projection as pj
from ..operators import climate, raster, spatial
from ..plans import landscape
from ..sources.readers import polygon_edges
from ..sources.writers import site_list
from .base import R, out, query, read

# --- climate -----------------------------------------------------------------

_ES = "CASE WHEN {t} < 0 THEN 0.61078 * exp(21.875 * {t} / ({t} + 265.5)) ELSE 0.61078 * exp(17.269 * {t} / ({t} + 237.3)) END"
_VPD = f"(({_ES.format(t='tmin')}) + ({_ES.format(t='tmax')})) / 2 - vp / 1000"
_DAILY = f"""d0 AS (SELECT l_orderkey, l_linenumber, l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(dayofyear(l_shipdate) AS INTEGER) AS yday,
 l_discount * 100 AS precip, l_quantity AS tmax, l_quantity - 20 AS tmin, l_tax * 10000 AS vp FROM lineitem),
d AS (SELECT *, {_VPD} AS vpd FROM d0)"""
_MEASURES = ["precip", "tmax", "tmin", "vpd"]
_YEARLY = _DAILY + ", y AS (SELECT site, year, " + ", ".join(f"avg({m}) AS {m}" for m in _MEASURES) + \
    " FROM d WHERE yday > 150 AND yday < 244 GROUP BY 1, 2)"
_WINDOWS = {"short": (1996, 2001), "long": (1995, 2000)}


def _daily(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("yday"),
        (F.col("l_discount") * 100).alias("precip"), F.col("l_quantity").alias("tmax"), (F.col("l_quantity") - 20).alias("tmin"),
        (F.col("l_tax") * 10000).alias("vp"))


@query(f"WITH {_DAILY} SELECT l_orderkey, l_linenumber, site, {R('vpd')} AS vpd FROM d")
def vpd_daily(spark, d):
    return out(climate.daily_deficit(_daily(spark, d)), "l_orderkey", "l_linenumber", "site", "vpd")


@query(f"WITH {_YEARLY} SELECT site, year, " + ", ".join(f"{R(m)} AS {m}" for m in _MEASURES) + " FROM y")
def season_year_mean(spark, d):
    return out(climate.seasonal_means(climate.daily_deficit(_daily(spark, d)), "site"))


@query(f"WITH {_YEARLY}, w AS (SELECT 'short' AS FRI, * FROM y WHERE year BETWEEN 1996 AND 2001 UNION ALL SELECT 'long', * FROM y WHERE year BETWEEN 1995 AND 2000), "
       "a AS (SELECT *, max(year) OVER (PARTITION BY FRI) AS last, " + ", ".join(f"avg({m}) OVER (PARTITION BY FRI, site) AS {m}_avg" for m in _MEASURES)
       + " FROM w) SELECT FRI, site AS plot_num, year, year + 1 AS season, " + ", ".join(f"{R(m)} AS {m}, {R(m + '_avg')} AS {m}_avg, {R(f'{m} - {m}_avg')} AS {m}_anom" for m in _MEASURES)
       + " FROM a WHERE year = last")
def climate_anomaly(spark, d):
    return out(landscape.climate_table(_daily(spark, d), _WINDOWS))


# --- rasters -----------------------------------------------------------------

_GRID = raster.Grid(xmin=0.0, ymax=100000.0, res=100.0, nrow=1_000_000_000, ncol=50)
_CELLS = "c AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS \"row\", CAST(p_partkey % 50 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part)"


def _cells(spark, d, value="p_size"):
    return read(spark, d, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"),
                                         (F.col("p_partkey") % 50).cast("int").alias("col"), F.expr(value).cast("double").alias("value"))


_POINTS = "p AS (SELECT c_custkey, c_acctbal AS x, 100000 - (c_custkey * 7919 % 41000) / 10.0 AS y FROM customer)"


def _points(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"),
                                             (100000 - (F.col("c_custkey") * 7919 % 41000) / 10.0).alias("y"))


_N8 = "n AS (SELECT c.\"row\", c.col, c.value, " + ", ".join(
    f"max(o.value) FILTER (o.\"row\" = c.\"row\" + {i} AND o.col = c.col + {j}) AS v{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1)) + \
    ", count(*) AS k FROM c JOIN c o ON abs(o.\"row\" - c.\"row\") <= 1 AND abs(o.col - c.col) <= 1 GROUP BY 1, 2, 3)"
_EAST = "((v02 + 2 * v12 + v22) - (v00 + 2 * v10 + v20)) / 800"
_NORTH = "((v00 + 2 * v01 + v02) - (v20 + 2 * v21 + v22)) / 800"


@query(f"""WITH {_CELLS}, {_N8}, g AS (SELECT *, {_EAST} AS ge, {_NORTH} AS gn FROM n)
SELECT "row", col, {R('CASE WHEN k = 9 THEN degrees(atan(sqrt(ge * ge + gn * gn))) END')} AS slope,
 {R('CASE WHEN k < 9 THEN NULL WHEN ge = 0 AND gn = 0 THEN 90 ELSE degrees(atan2(-ge, -gn)) + CASE WHEN degrees(atan2(-ge, -gn)) < 0 THEN 360 ELSE 0 END END')} AS aspect FROM g""")
def terrain_slope_aspect(spark, d):
    return out(raster.terrain(_cells(spark, d), 100.0, tile=16), "row", "col", "slope", "aspect")


@query(f"""WITH {_CELLS}, {_N8} SELECT "row", col, {R('CASE WHEN k = 9 THEN value - (v00+v01+v02+v10+v12+v20+v21+v22) / 8 END')} AS tpi FROM n""")
def terrain_tpi(spark, d):
    return out(raster.terrain(_cells(spark, d), 100.0), "row", "col", "tpi")


@query(f"""WITH {_CELLS}, {_N8} SELECT "row", col, """ + R("CASE WHEN k = 9 THEN (" + " + ".join(
    f"abs(v{i}{j} - value)" for i in range(3) for j in range(3) if (i, j) != (1, 1)) + ") / 8 END") + " AS tri FROM n")
def terrain_tri(spark, d):
    return out(raster.terrain(_cells(spark, d), 100.0, tile=64), "row", "col", "tri")


@query(f"""WITH {_CELLS}, {_N8}, {_POINTS}, g AS (SELECT *, {_EAST} AS ge, {_NORTH} AS gn FROM n),
t AS (SELECT "row", col, value, CASE WHEN k = 9 THEN degrees(atan(sqrt(ge * ge + gn * gn))) END AS slope,
 CASE WHEN k < 9 THEN NULL WHEN ge = 0 AND gn = 0 THEN 90 ELSE degrees(atan2(-ge, -gn)) END AS asp FROM g)
SELECT c_custkey, value AS elev, {R('slope')} AS slope, {R('cos(radians(45.0) - radians(asp)) + 1')} AS dev_ne
FROM p LEFT JOIN t ON t.col = floor(x / 100) AND t."row" = floor((100000 - y) / 100)""")
def terrain_at_points(spark, d):
    return out(landscape.terrain_predictors(_points(spark, d), _cells(spark, d), _GRID), "c_custkey", "elev", "slope", "dev_ne")


@query(f"""WITH {_CELLS}, {_POINTS} SELECT c_custkey, value FROM p LEFT JOIN c ON c.col = floor(x / 100) AND c."row" = floor((100000 - y) / 100)""")
def sample_raster(spark, d):
    return raster.sample(_points(spark, d), _cells(spark, d), _GRID).select("c_custkey", "value")


@query(f"""WITH {_CELLS} SELECT "row", col, CASE WHEN value > 0 AND value <= 10 THEN 1.0 WHEN value > 10 AND value <= 30 THEN NULL ELSE value END AS value FROM c""")
def reclassify(spark, d):
    return raster.reclassify(_cells(spark, d), [(0, 10, 1), (10, 30, None)])


@query(f"""WITH {_CELLS} SELECT "row", col, value, CAST(col * 100.0 + 50 AS DOUBLE) AS x, CAST(100000 - "row" * 100.0 - 50 AS DOUBLE) AS y FROM c WHERE value <= 40""")
def raster_points(spark, d):
    return raster.to_points(_cells(spark, d, "CASE WHEN p_size <= 40 THEN p_size END"), _GRID).select("row", "col", "value", "x", "y")


@query(f"""WITH {_CELLS} SELECT "row", col, value FROM c WHERE col * 100.0 + 50 BETWEEN 720 AND 3350 AND 100000 - "row" * 100.0 - 50 BETWEEN 97000 AND 99450""")
def crop_cells(spark, d):
    return raster.crop(_cells(spark, d), _GRID, 720, 3350, 97000, 99450)


@query(f"""WITH {_CELLS}, {_POINTS}, e AS (SELECT min(x) - 0.01 AS x0, max(x) + 0.01 AS x1, min(y) - 0.01 AS y0, max(y) + 0.01 AS y1 FROM p WHERE x BETWEEN 1000 AND 4000)
SELECT "row", col, value FROM c, e WHERE col * 100.0 + 50 BETWEEN x0 AND x1 AND 100000 - "row" * 100.0 - 50 BETWEEN y0 AND y1""")
def crop_to_points(spark, d):
    pts = _points(spark, d).filter("x BETWEEN 1000 AND 4000")
    return raster.crop_to_points(_cells(spark, d), _GRID, pts)


_STAR = """v AS (SELECT n_nationkey AS seq, 2500 + (900 + 250 * (n_nationkey * 7 % 5)) * cos(2 * pi() * n_nationkey / 25) AS x,
 98000 + (900 + 250 * (n_nationkey * 7 % 5)) * sin(2 * pi() * n_nationkey / 25) AS y FROM nation),
e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.seq = (a.seq + 1) % 25)"""


def _perimeter(spark, d):
    k = F.col("n_nationkey")
    angle, radius = 2 * F.lit(math.pi) * k / 25, 900 + 250 * (k * 7 % 5)
    v = read(spark, d, "nation").select(F.floor(k / 25).alias("poly_id"), F.floor(k / 30).alias("ring"), k.alias("seq"),
                                        (2500 + radius * F.cos(angle)).alias("x"), (98000 + radius * F.sin(angle)).alias("y"))
    return polygon_edges(v)


_INSIDE = """m AS (SELECT c."row", c.col, c.value FROM c JOIN e ON 99950 - c."row" * 100.0 >= least(y1, y2) AND 99950 - c."row" * 100.0 < greatest(y1, y2)
 AND x1 + (99950 - c."row" * 100.0 - y1) * (x2 - x1) / (y2 - y1) > c.col * 100.0 + 50 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query(f"""WITH {_CELLS}, {_STAR}, {_INSIDE} SELECT "row", col, value FROM m""")
def mask_polygon(spark, d):
    return raster.mask(_cells(spark, d), _perimeter(spark, d), _GRID)


@query(f"""WITH {_CELLS}, a AS (SELECT * FROM c WHERE col < 30), b AS (SELECT "row", col, 60 - value AS value FROM c WHERE col >= 20)
SELECT "row", col, max(value) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def mosaic_max(spark, d):
    a = _cells(spark, d).filter("col < 30")
    b = _cells(spark, d, "60 - p_size").filter("col >= 20")
    return raster.mosaic([a, b])


_LAYERS = """l AS (SELECT l_returnflag AS layer, CAST(l_partkey // 50 AS INTEGER) AS "row", CAST(l_partkey % 50 AS INTEGER) AS col,
 CASE WHEN max(l_quantity) >= 40 THEN avg(l_quantity) END AS value FROM lineitem GROUP BY 1, 2, 3)"""


def _layers(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("layer"), F.floor(F.col("l_partkey") / 50).cast("int").alias("row"),
                      (F.col("l_partkey") % 50).cast("int").alias("col")).agg(
        F.when(F.max("l_quantity") >= 40, F.avg("l_quantity")).alias("value"))


@query(f"""WITH {_LAYERS} SELECT "row", col, {R('CASE WHEN count(value) = count(*) THEN avg(value) END')} AS value FROM l GROUP BY 1, 2""")
def layer_mean(spark, d):
    return out(raster.layer_mean(_layers(spark, d)))


@query(f"""WITH {_CELLS}, t AS (SELECT i // 35 AS "row", i % 35 AS col FROM (SELECT unnest(range((SELECT count(*) // 65 FROM part) * 35)) AS i)),
g AS (SELECT "row", col, (0.98 * (130.0 * (col + 0.5)) + 20) / 100 - 0.5 AS u, (100000 - (100000 - 130.0 * ("row" + 0.5) - 15)) / 100 - 0.5 AS v FROM t),
q AS (SELECT "row", col, floor(v) + dr AS sr, floor(u) + dc AS sc,
 (CASE WHEN dr = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN dc = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
 FROM g, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc))
SELECT CAST(q."row" AS INTEGER) AS "row", CAST(q.col AS INTEGER) AS col, {R('CASE WHEN count(value) = count(*) THEN sum(w * value) END')} AS value
FROM q LEFT JOIN c ON c."row" = sr AND c.col = sc WHERE w > 0 GROUP BY 1, 2""")
def resample_grid(spark, d):
    n = read(spark, d, "part").count()
    target = raster.Grid(0.0, 100000.0, 130.0, n // 65, 35)
    return out(raster.resample(_cells(spark, d), _GRID, target, lambda x, y: (0.98 * x + 20, y - 15)))


@query(f"""WITH {_CELLS}, {_LAYERS}, k AS (SELECT "row", col, CASE WHEN count(value) = count(*) THEN avg(value) END AS clay FROM l GROUP BY 1, 2)
SELECT c."row", c.col, c.value, CAST(col * 100.0 + 50 AS DOUBLE) AS x, CAST(100000 - c."row" * 100.0 - 50 AS DOUBLE) AS y, {R('clay')} AS clay
FROM c LEFT JOIN k USING ("row", col) WHERE c.col * 100.0 + 50 BETWEEN 0 AND 4000 AND 100000 - c."row" * 100.0 - 50 BETWEEN 90000 AND 99000""")
def prediction_grid(spark, d):
    return out(raster.prediction_grid(_cells(spark, d), _GRID, (0, 4000, 90000, 99000), {"clay": raster.layer_mean(_layers(spark, d))}))


@query(f"""WITH {_CELLS}, {_STAR}, {_INSIDE}, s AS (SELECT "row", col, value FROM m UNION ALL SELECT "row", col, 45 - value FROM c WHERE col > 25),
t AS (SELECT "row", col, max(value) AS value FROM s GROUP BY 1, 2) SELECT "row", col, value FROM t""")
def severity_mosaic(spark, d):
    first = raster.mask(_cells(spark, d), _perimeter(spark, d), _GRID)
    second = _cells(spark, d, "45 - p_size").filter("col > 25")
    return raster.mosaic([first, second])


# --- points ------------------------------------------------------------------

@query(f"""WITH {_CELLS}, {_POINTS}, s AS (SELECT col * 100.0 + 50 AS fx, 100000 - "row" * 100.0 - 50 AS fy FROM c WHERE value * 30 - 100 <= 288)
SELECT c_custkey, {R('min(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)))', 4)} AS dist_unburned FROM p, s GROUP BY 1""")
def nearest_cell(spark, d):
    burn = landscape.severity_predictors(_points(spark, d), _cells(spark, d, "p_size * 30 - 100"), _GRID)
    return out(burn, "c_custkey", "dist_unburned", digits=4)


_XYZ = "p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS y, c_nationkey AS z FROM customer)"


def _xyz(spark, d):
    return read(spark, d, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 1000).cast("double").alias("y"),
                                             F.col("c_nationkey").alias("z"))


@query(f"""WITH {_XYZ}, q AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id < b.id)
SELECT count(*) AS n_pairs, {R('median(d)', 4)} AS median_distance FROM q""")
def pair_median(spark, d):
    return out(spatial.pair_distance_median(_xyz(spark, d)), digits=4)


@query(f"""WITH {_XYZ}, c AS (SELECT (max(y) - min(y)) / 2 AS h FROM p),
q AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.z - b.z) * (a.z - b.z) AS s FROM p a JOIN p b ON a.id < b.id)
SELECT CAST(least(floor(d / (h / 50)), 49) AS INTEGER) AS lag, count(*) AS np, {R('avg(d)', 4)} AS dist, {R('avg(s) / 2', 4)} AS gamma FROM q, c WHERE d <= h GROUP BY 1""")
def semivariogram(spark, d):
    pts = _xyz(spark, d)
    cutoff, width = spatial.variogram_defaults(pts)
    return out(spatial.semivariogram(pts, "z", cutoff, width), digits=4)


def _terms(var, coef, pattern):
    return " + ".join([var] + [f"({k!r}) * " + pattern.format(m=2 * j) for j, k in enumerate(coef, 1)])


_K = repr(pj.SCALE * pj.RADIUS)
_GEO = f"""g0 AS (SELECT c_custkey, (5380000.0 + c_custkey) / {_K} AS xi, (270000.0 + c_acctbal - 500000.0) / {_K} AS eta FROM customer),
g1 AS (SELECT c_custkey, {_terms('xi', [-k for k in pj.INVERSE], 'sin({m} * xi) * cosh({m} * eta)')} AS xi1,
 {_terms('eta', [-k for k in pj.INVERSE], 'cos({m} * xi) * sinh({m} * eta)')} AS eta1 FROM g0),
g2 AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM g1),
g3 AS (SELECT c_custkey, degrees({_terms('chi', pj.LATITUDE, 'sin({m} * chi)')}) AS lat, degrees(atan2(sinh(eta1), cos(xi1))) - 111.0 AS lon FROM g2)"""


def _utm_points(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("plot_num"), (270000.0 + F.col("c_acctbal")).alias("x"),
                                             (5380000.0 + F.col("c_custkey")).alias("y"))


@query(f"WITH {_GEO} SELECT c_custkey AS site, {R('lat', 7)} AS lat, {R('lon', 7)} AS lon FROM g3")
def site_coordinates(spark, d):
    return out(site_list(_utm_points(spark, d)), digits=7)


@query(f"SELECT c_custkey AS plot_num, {R('270000.0 + c_acctbal', 3)} AS easting, {R('5380000.0 + c_custkey', 3)} AS northing FROM customer")
def reproject_round_trip(spark, d):
    geo = site_list(_utm_points(spark, d))
    e, n = pj.to_utm("lat", "lon")
    return out(geo.select(F.col("site").alias("plot_num"), e.alias("easting"), n.alias("northing")), digits=3)
