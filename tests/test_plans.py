"""Whole jobs on small hand-made survey tables, and source/sink round trips."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrove import sources as io
from regrove.functions import ecology as eco
from regrove.operators import climate, forest, raster as ra
from regrove.plans import landscape, modelling, survey


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()


def test_cold_day_uses_the_ice_curve(spark):
    r = one(spark.range(1).select(eco.vapour_deficit(F.lit(-5.0), F.lit(10.0), F.lit(300.0)).alias("v")))
    ice = 0.61078 * math.exp(21.875 * -5 / (-5 + 265.5))
    water = 0.61078 * math.exp(17.269 * 10 / (10 + 237.3))
    assert r["v"] == pytest.approx((ice + water) / 2 - 0.3)


def test_basal_area_of_one_stem(spark):
    r = one(spark.range(1).select(eco.basal_area(F.lit(200.0), F.lit(2)).alias("b"), eco.northeastness(F.lit(45.0)).alias("n")))
    assert r["b"] == pytest.approx(math.pi * 0.1 ** 2 / 0.035) and r["n"] == pytest.approx(2.0)


@pytest.fixture(scope="module")
def plots(spark):
    points = io.point_layer(frame(spark, [("P1", "d1", 1.0, 2.0), ("P2", "d2", 3.0, 4.0), ("P2", "d9", 3.0, 4.0), ("P3", "d3", 5.0, 6.0)],
                                  "name string, today string, x double, y double"), ["name", "today"])
    cols = {"name": ["P1", "P2", "P2", "P4"], "today": ["d1", "d2", "d9", "d4"], "season": ["2019", "2020", "2020", "2019"],
            "canopy_1": [1.0, 4.0, 4.0, 0.0], "canopy_2": [2.0, None, 4.0, 0.0], "canopy_3": [3.0, 4.0, 4.0, 0.0], "canopy_4": [4.0, 4.0, 4.0, 0.0],
            "phys_elev": [1200.0, 1350.0, 1350.0, 1.0], "seeds_dist_cone": [10.0, 20.0, 20.0, 1.0], "prefire_n_quads": [4, 2, 2, 1],
            "prefire_q1_1_sp": ["PICO", "other", "other", "ABLA"], "prefire_q1_1_dbh": ["200", "100", "100", "1"],
            "prefire_q1_1_cones": ["1", None, None, None], "prefire_q1_1_serotinous": ["1", None, None, None],
            "prefire_q2_1_sp": ["LAOC", "PSME", "PSME", None], "prefire_q2_1_dbh": ["100", "bad", "bad", None],
            "prefire_q2_1_cones": [None, None, None, None], "prefire_q2_1_serotinous": [None] * 4, "prefire_note": ["x", "y", "y", "z"],
            "seedlings_t1_length": [None, 30.0, 30.0, 1.0], "seedlings_t2_length": [28.0, None, None, 1.0],
            "seedlings_t1_age1_PICO": [10, 0, 0, 0], "seedlings_t2_age1_LAOC": [None, 0, 0, 0], "seedlings_t2_age1_other": [5, 5, 5, 5],
            "vegcover_t1_q1_forb": [10.0, 5.0, 5.0, 0.0], "vegcover_t1_q2_forb": [20.0, None, None, 0.0], "vegcover_t1_q1_total": [50.0, 60.0, 60.0, 0.0]}
    pdf = pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in cols.items()})
    kinds = {"season": "string", "prefire_n_quads": "int"}
    schema = ", ".join(f"{c} " + kinds.get(c, "double" if c.startswith(("canopy", "phys", "seeds_", "veg")) or c.endswith("length") else
                                           "int" if c.startswith("seedlings") else "string") for c in cols)
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in pdf.itertuples(index=False)]
    return survey.plots_with_points(points, spark.createDataFrame(rows, schema)).persist()


def test_plots_are_matched_numbered_and_deduplicated(plots):
    # P3 has no visit and P4 no point; the second point of P2 shares its location.
    got = plots.select("plot_id", "plot_num").collect()
    assert {r["plot_id"] for r in got} == {"P1-d1", "P2-d2", "P3-d3"} and len({r["plot_num"] for r in got}) == 3


def test_missing_quadrant_spoils_the_canopy_mean(plots):
    got = {r["plot_id"]: r["canopy"] for r in survey.plot_info(plots).collect()}
    assert got["P1-d1"] == 2.5 and got["P2-d2"] is None


def test_prefire_and_postfire_tables(plots):
    pre = {(r["season"], r["sp"]): r for r in survey.prefire_structure(plots).collect()}
    pico, laoc = math.pi * 0.1 ** 2 / 0.07, math.pi * 0.05 ** 2 / 0.07
    assert pre["2019", "PICO"]["basal"] == pytest.approx(pico) and pre["2019", "PICO"]["serot"] == 1.0
    assert pre["2019", "PICO"]["impval"] == pytest.approx(0.5 + pico / (pico + laoc))
    assert sum(r["impval"] for (s, _), r in pre.items() if s == "2019") == pytest.approx(2.0)
    assert pre["2020", "THPL"]["dens_ha"] == pytest.approx(1 / 0.035)
    assert pre["2020", "PSME"]["basal"] is None  # an unreadable diameter poisons the sum
    post = {(r["season"], r["sp"]): r for r in survey.postfire_structure(plots).collect()}
    assert post["2019", "PICO"]["dens_ha"] == pytest.approx(10 / 112 * 10000) and post["2019", "PICO"]["impval"] == 1.0
    assert post["2020", "PICO"]["impval"] == 0.0 and not any(sp == "other" for _, sp in post)


def test_cover_features_and_dominance(plots):
    cover = survey.understory_cover(plots)
    got = {r["plot_id"]: r for r in cover.collect()}
    assert got["P1-d1"]["forb"] == 15.0 and got["P2-d2"]["forb"] is None and got["P2-d2"]["total"] == 60.0
    pre, post = survey.prefire_structure(plots), survey.postfire_structure(plots)
    feats = {r["season"]: r for r in survey.plot_features(pre, post, survey.plot_info(plots), cover).filter("season is not null").collect()}
    assert feats["2019"]["serot"] == 1 and feats["2019"]["post_dens_ha_PICO"] == pytest.approx(feats["2019"]["post_dens_ha_all"])
    assert feats["2020"]["pre_dens_ha_THPL"] == pytest.approx(1 / 0.035) and feats["2020"]["pre_basal_ABLA"] == 0.0
    change, table = survey.dominance(pre, post)
    states = {(r["season"], r["pre_sp"], r["post_sp"]) for r in change.filter("season is not null").collect()}
    # The unreadable diameter leaves the second plot without importance values before the fire.
    assert ("2019", "PICO", "PICO") in states and ("2020", None, "None") in states
    assert table.filter("time = 'post_sp' AND dom_sp = 'None'").first()["n"] >= 1


def test_split_tree_merges(spark):
    rec = frame(spark, [("t", 1, "PICO", 1, 10.0, None), ("t", 2, "other", None, 12.0, None), ("u", 1, "ABLA", None, 5.0, 1)],
                "tree string, part int, sp string, cones int, dbh double, serotinous int")
    got = {r["tree"]: r for r in forest.merge_split_trees(rec, ["tree"], "part").collect()}
    assert (got["t"]["sp"], got["t"]["dbh"], got["t"]["serotinous"]) == ("PICO", 12.0, 0)
    assert got["u"]["cones"] == 0 and got["u"]["serotinous"] is None


def test_climate_windows(spark):
    daily = frame(spark, [(1, y, d, float(y - 1989), 20.0, 5.0, 500.0) for y in range(1989, 2020) for d in (150, 151, 243, 244)],
                  "site int, year int, yday int, precip double, tmax double, tmin double, vp double")
    got = {r["FRI"]: r for r in landscape.climate_table(daily).collect()}
    assert (got["short"]["year"], got["short"]["season"], got["long"]["season"]) == (2019, 2020, 2019)
    assert got["short"]["precip_anom"] == pytest.approx(30 - 15.5) and got["long"]["precip_avg"] == pytest.approx(14.5)
    yearly = climate.seasonal_means(climate.daily_deficit(daily))
    norm = climate.normals_and_anomalies(yearly, {f"w{y}": (1990, y) for y in range(1990, 2000)}).filter("precip_anom < 0").count()
    assert norm == 0


@pytest.fixture(scope="module")
def grid():
    return ra.Grid(0.0, 1000.0, 10.0, 100, 100)


def test_predictor_table_and_models(spark, grid):
    rng = np.random.default_rng(3)
    n = 60
    pts = spark.createDataFrame(pd.DataFrame({"plot_num": np.arange(1, n + 1), "x": rng.uniform(100, 900, n), "y": rng.uniform(100, 900, n)}))
    elev = spark.range(10000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"),
                                     (F.sin(F.col("id") / 37.0) * 50 + F.col("id") % 100).alias("value"))
    sev = elev.select("row", "col", (F.col("value") * 5).alias("value"))
    daily = spark.createDataFrame(pd.DataFrame([(s, y, d, 1.0, 20.0 + s % 7, 5.0, 700.0 + 10 * (s % 11)) for s in range(1, n + 1) for y in (2018, 2019) for d in (160, 200)],
                                               columns=["site", "year", "yday", "precip", "tmax", "tmin", "vp"]))
    soil = spark.createDataFrame(pd.DataFrame({"plot_num": np.arange(1, n + 1), "pH": 6.0, "OM": rng.normal(5, 1, n), "TN": 1.0}))
    feats = spark.createDataFrame(pd.DataFrame({
        "plot_num": np.arange(1, n + 1), "season": np.where(np.arange(n) % 2 == 0, 2019, 2020), "serot": (np.arange(n) % 3 == 0).astype(float),
        "canopy": rng.uniform(0, 100, n), "post_dens_ha_PICO": rng.poisson(200, n) + 0.4, "post_dens_ha_LAOC": rng.poisson(rng.gamma(1, 50, n)) + 0.0,
        "pre_basal_PICO": rng.gamma(2, 5, n), "pre_basal_LAOC": rng.gamma(2, 5, n), "pre_basal_all": rng.gamma(4, 5, n)}))
    gd = ra.Grid(-115.5, 9.1, 0.001, 200, 2000)
    clay = spark.createDataFrame([("a", 0, 0, 1.0)], "layer string, row int, col int, value double")
    table = landscape.predictor_table(feats, pts, (elev, grid), (sev, grid), daily, soil, {"clay": (clay, gd)},
                                      {"short": (2018, 2019), "long": (2018, 2018)}).persist()
    assert table.count() == n and {"elev", "dev_ne", "slope", "tpi", "tri", "rdnbr", "dist_unburned", "vpd", "OM", "clay"} <= set(table.columns)
    design = modelling.scaled_design(table, extra=["dist_unburned", "serot", "canopy", "dev_ne", "tmax", "vpd", "tpi", "OM"]).persist()
    assert abs(design.agg(F.avg("OM")).first()[0]) < 1e-9
    fit, coefs, effects = modelling.species_models(design, ["PICO", "LAOC"])
    assert coefs.count() == 12 and effects.count() == 10 and effects.filter("type is null").count() == 0
    assert {r["term"] for r in coefs.collect()} >= {"prefire_BA_sp", "serot", "OM"}
    avg = modelling.averaged_effects(design, ["LAOC"], ["pre_basal_all", "dist_unburned", "vpd", "OM"], max_terms=2)
    assert avg.filter("term = '(Intercept)'").count() == 1


def test_composition_and_structure_jobs(spark):
    rng = np.random.default_rng(11)
    rows = [(t, p, "2019" if p % 2 else "2020", s, float(rng.gamma(1, 300)) if rng.random() < 0.6 else 0.0)
            for t in ("prefire", "postfire") for p in range(40) for s in survey.SPECIES]
    df = spark.createDataFrame(rows, "time string, plot_num int, season string, sp string, dens_ha double")
    pre, post = df.filter("time = 'prefire'"), df.filter("time = 'postfire'")
    c = modelling.composition_change(pre, post, permutations=49, starts=4)
    assert c.dissimilarity.filter("bray < 0 OR bray > 1").count() == 0
    assert c.anosim.first()["n_groups"] == 4 and c.centroids.count() == 4 and c.species.count() == 8 and c.anova.count() == 1
    tables = modelling.density_comparison(modelling.plot_densities(pre, post))
    assert {k: v.count() for k, v in tables.items() if k in ("medians", "median_test", "ks", "line", "correlation", "band")} == {
        "medians": 2, "median_test": 2, "ks": 2, "line": 4, "correlation": 2, "band": 160}
    cover = spark.createDataFrame(pd.DataFrame({"plot_num": range(40), "season": ["2019", "2020"] * 20, **{
        k: rng.uniform(0, 60, 40) for k in ("forb", "gram", "shrub", "total")}}))
    got = modelling.cover_comparison(cover, reps=200)
    assert got["anova"].count() == 4 and got["tukey"].count() == 4 and got["box"].count() == 8
    assert got["means"].filter("letters is null OR lower > mean OR upper < mean").count() == 0


def test_severity_mosaic_and_prediction_surface(spark, grid):
    cells = spark.range(10000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.lit(1.0).alias("value"))
    square = lambda lo, hi: io.polygon_edges(frame(spark, [(1, 0, k, *xy) for k, xy in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi)])],
                                                   "poly_id int, ring int, seq int, x double, y double"))
    merged = landscape.severity_mosaic([(cells, square(100.0, 500.0)), (cells.withColumn("value", F.lit(2.0)), square(300.0, 700.0))], grid, grid,
                                       lambda x, y: (x, y))
    got = {r["value"]: r["n"] for r in merged.filter("value is not null").groupBy("value").agg(F.count("*").alias("n")).collect()}
    assert got == {1.0: 1600 - 400, 2.0: 1600}
    small = ra.Grid(200.0, 800.0, 10.0, 30, 20)
    assert landscape.prediction_surface(cells, grid, cells, small).count() == 600


def test_sources_and_sinks(spark, grid):
    root = tempfile.mkdtemp(prefix="regrove-test-")
    df = frame(spark, [(1, "a", None), (2, None, 2.5)], "id int, k string, v double")
    io.save_csv(df, f"{root}/csv")
    assert sorted(map(tuple, io.csv_table(spark, f"{root}/csv", "id int, k string, v double").collect())) == [(1, "a", None), (2, None, 2.5)]
    assert dict(io.csv_table(spark, f"{root}/csv").dtypes)["v"] == "double"
    io.save_csv(df.select("id", F.lit(7).alias("extra")), f"{root}/csv2")
    assert io.csv_tables(spark, [f"{root}/csv", f"{root}/csv2"]).filter("extra = 7 AND k is null").count() == 2
    io.save_stage(df, root, "stage1")
    assert io.stage(spark, root, "stage1").count() == 2
    cells = frame(spark, [(0, 0, 1.5)], "row int, col int, value double")
    io.save_raster(cells, grid, f"{root}/r")
    back, spec = io.raster_cells(spark, f"{root}/r")
    assert spec == grid and tuple(back.first()) == (0, 0, 1.5)
    for name in ("soil_clay_0", "soil_clay_1", "other"):
        cells.write.parquet(f"{root}/layers/{name}.parquet")
    got = {r["layer"] for r in io.layer_stack(spark, f"{root}/layers/soil_clay*").collect()}
    assert got == {"soil_clay_0", "soil_clay_1"}
    bundle = spark.sql("SELECT 7 AS site, array(named_struct('year', 2000, 'yday', 1, 'tmax..deg.c.', 3.0D)) AS data")
    assert tuple(one(io.climate_bundle(bundle, names={"tmax..deg.c.": "tmax"}))) == (7, 2000, 1, 3.0)
    site = one(io.site_list(frame(spark, [(1, 500000.0, 5382000.0)], "plot_num int, x double, y double")))
    assert site["lon"] == pytest.approx(-111.0) and 48.5 < site["lat"] < 48.7
