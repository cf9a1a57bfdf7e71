"""Files written and read back, and cases that plain tables do not show: column order, overlaps, missing samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import hypothesis as hy, ordered, raster, summaries as sm
from ..session import shared_folder
from ..sources import readers, writers
from .base import R, out, query, read
from .climate_raster import _CELLS, _cells, _GRID


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS p_retailprice FROM part")
def csv_by_name(spark, d):
    """Two CSV exports whose columns stand in different orders; one lacks a column."""
    at, part = _folder(spark), read(spark, d, "part")
    writers.save_csv(part.filter("p_partkey % 2 = 0").select("p_retailprice", "p_brand", "p_partkey", "p_size"), f"{at}/even")
    writers.save_csv(part.filter("p_partkey % 2 = 1").select("p_size", "p_partkey", "p_brand"), f"{at}/odd")
    return readers.csv_tables(spark, [f"{at}/even", f"{at}/odd"], "p_partkey bigint, p_brand string, p_size int, p_retailprice double")


@query("SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_brand <> 'NA' THEN p_brand END AS p_brand FROM part")
def csv_guessed_types(spark, d):
    """A CSV export read back with guessed types."""
    at = _folder(spark)
    writers.save_csv(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), at)
    return readers.csv_table(spark, at)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
def stage_round_trip(spark, d):
    """A stage table by partition, read with the filter that prunes it."""
    at = _folder(spark)
    writers.save_stage(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), at, "orders", ["o_orderpriority"])
    return readers.stage(spark, at, "orders").filter("o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("SELECT 'status_' || o_orderstatus AS layer, o_orderkey, o_totalprice FROM orders")
def layer_stack_by_glob(spark, d):
    """One layer written per order status; all layers of a pattern read in one scan, each row tagged with its layer."""
    at, orders = _folder(spark), read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status in "FOP":
        writers.save_stage(orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), at, f"status_{status}")
    writers.save_stage(orders.limit(0), at, "other")        # outside the pattern
    return readers.layer_stack(spark, f"{at}/status_*").select("layer", "o_orderkey", "o_totalprice")


@query("SELECT CAST(l_orderkey AS BIGINT) AS site, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS tmax, l_discount FROM lineitem")
def nested_bundle(spark, d):
    """The items of each order written as one nested array a row, read back and flattened beside the order."""
    at = _folder(spark)
    items = read(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), "l_quantity", "l_discount").alias("item"))
    writers.save_stage(items.groupBy(F.col("l_orderkey").alias("site")).agg(F.collect_list("item").alias("data")), at, "bundle")
    flat = readers.climate_bundle(readers.stage(spark, at, "bundle"), names={"l_quantity": "tmax"})
    return flat.select(F.col("site").cast("bigint"), F.col("line").cast("bigint"), "tmax", "l_discount")


@query(f"""WITH {_CELLS} SELECT "row", col, value, {_GRID.res} AS res FROM c""")
def raster_round_trip(spark, d):
    """A raster and its grid written and read back."""
    at = _folder(spark)
    writers.save_raster(_cells(spark, d), _GRID, at)
    cells, grid = readers.raster_cells(spark, at)
    return cells.select("row", "col", "value", F.lit(float(grid.res)).alias("res"))


def _square(k: int, at: int, size: int):
    return [(k, 0, i, float(at + dx * size), float(95000 + at + dy * size)) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


@query(f"""WITH {_CELLS} SELECT "row", col, value FROM c
WHERE (col * 100.0 + 50 BETWEEN 1010 AND 3010 AND 99950 - "row" * 100.0 BETWEEN 96010 AND 98010)
   OR (col * 100.0 + 50 BETWEEN 2010 AND 4010 AND 99950 - "row" * 100.0 BETWEEN 97010 AND 99010)""")
def mask_overlap(spark, d):
    """Cells in either of two overlapping perimeters."""
    corners = spark.createDataFrame(_square(1, 1010, 2000) + _square(2, 2010, 2000), "poly_id int, ring int, seq int, x double, y double")
    return raster.mask(_cells(spark, d), readers.polygon_edges(corners), _GRID)


@query(f"""WITH x AS (SELECT o_orderpriority AS k, o_totalprice AS v, count(*) FILTER (o_orderstatus = 'O') AS a,
  count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%') AS b FROM orders
  WHERE o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%' GROUP BY 1, 2),
c AS (SELECT k, abs(sum(a) OVER w / sum(a) OVER t - CASE WHEN sum(b) OVER t > 0 THEN sum(b) OVER w / sum(b) OVER t END) AS g, sum(a) OVER t AS n1, sum(b) OVER t AS n2 FROM x
  WINDOW w AS (PARTITION BY k ORDER BY v), t AS (PARTITION BY k))
SELECT k AS o_orderpriority, {R('max(g)')} AS d, CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n2) AS BIGINT) AS n2 FROM c GROUP BY 1""")
def ks_missing_sample(spark, d):
    """One priority has no second sample: its gap is null and the others keep theirs."""
    o = read(spark, d, "orders").filter("o_orderstatus <> 'P' OR o_orderpriority NOT LIKE '1%'")
    return out(hy.ks_two_sample(o, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "O", "P"), "o_orderpriority", "d", "n1", "n2")


@query("""SELECT DISTINCT CAST(1152921504606846976 + o_custkey AS BIGINT) AS big,
 rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rank_big FROM orders""")
def rank_bigint(spark, d):
    """Ranks of whole numbers that differ by less than a double can tell."""
    o = read(spark, d, "orders").select((F.lit(1 << 60) + F.col("o_custkey")).alias("big"))
    return ordered.tie_ranks(o, [], "big")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def boxplot_outliers(spark, d):
    """The rows a box plot draws as points."""
    return sm.box_outliers(read(spark, d, "events"), ["event_type"], "value").select("event_id", "event_type", "value")


@query(f"""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL), w AS (SELECT *, (hi - lo) / 19.0 AS width FROM s)
SELECT CAST(floor((value - lo) / width + 0.5) AS INTEGER) AS bin, count(*) AS n, {R('any_value(lo + floor((value - lo) / width + 0.5) * width)')} AS center
FROM events, w GROUP BY 1""")
def histogram_all(spark, d):
    """Equal-width counts without a facet: the span is one row and meets the table without a join."""
    return out(sm.histogram(read(spark, d, "events"), [], "value", 20))
