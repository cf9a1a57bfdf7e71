"""Order statistics, rasters and distances against brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrove.functions import projection as pj
from regrove.operators import ordered as od, raster as ra, spatial as sp


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_quantiles_and_ranks_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(1000, 7.0), rng.lognormal(2, 3, 2000), np.zeros(50)])
    g = np.array(["a", "b", "b"])[rng.integers(0, 3, len(v))]
    df = frame(spark, g=g, v=v)
    got = {(r["g"], r["prob"]): r["quantile"] for r in od.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], blocks=16).collect()}
    for key in ("a", "b"):
        for p in (0.1, 0.5, 0.99):
            assert got[key, p] == pytest.approx(np.quantile(v[g == key], p), rel=1e-12)
    ranks = {r["v"]: r["rank_v"] for r in od.tie_ranks(df, [], "v", blocks=16).collect()}
    want = pd.Series(v).rank().to_numpy()
    assert all(ranks[x] == w for x, w in zip(v, want))


def plane(spark, n, fn):
    cells = [(i, j, float(fn(i, j))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(cells, "row int, col int, value double")


def test_tilted_plane(spark):
    # Rises 1 per cell to the east on a 10 m grid: faces west, slope atan(0.1).
    got = {(r["row"], r["col"]): r for r in ra.terrain(plane(spark, 5, lambda i, j: j), 10.0, tile=2).collect()}
    assert len(got) == 25
    for (i, j), r in got.items():
        if 0 < i < 4 and 0 < j < 4:
            assert r["slope"] == pytest.approx(math.degrees(math.atan(0.1))) and r["aspect"] == pytest.approx(270.0)
            assert r["tpi"] == pytest.approx(0.0) and r["tri"] == pytest.approx(6 / 8)
        else:
            assert r["slope"] is None and r["tpi"] is None


def test_flat_ground(spark):
    r = ra.terrain(plane(spark, 3, lambda i, j: 4.0), 10.0).filter("slope is not null").first()
    assert (r["slope"], r["aspect"], r["tpi"], r["tri"]) == (0.0, 90.0, 0.0, 0.0)


def test_tile_size_does_not_matter(spark):
    cells = plane(spark, 30, lambda i, j: (i * 31 + j * 17) % 23)
    a = {tuple(r) for r in ra.terrain(cells, 5.0, tile=7).collect()}
    assert a == {tuple(r) for r in ra.terrain(cells, 5.0, tile=256).collect()}


def test_missing_cell_spoils_its_neighbours(spark):
    holes = plane(spark, 5, lambda i, j: i).filter("NOT (row = 2 AND col = 2)")
    assert ra.terrain(holes, 1.0).filter("slope is not null").count() == 0


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    hot = np.tile([[50.0, 50.0]], (n // 3, 1))
    near = rng.normal([50, 50], 0.01, (n // 3, 2))
    far = rng.uniform(0, 1000, (n - 2 * (n // 3), 2))
    return np.vstack([hot, near, far])


def test_nearest_feature_with_hot_spots(spark):
    p, f = clustered(1, 300), clustered(2, 240) + 3.0
    pts = frame(spark, id=range(len(p)), x=p[:, 0], y=p[:, 1])
    feats = frame(spark, fx=f[:, 0], fy=f[:, 1])
    got = {r["id"]: r["distance"] for r in sp.nearest_feature(pts, feats, leaf_points=8).collect()}
    want = np.sqrt(((p[:, None] - f[None]) ** 2).sum(-1)).min(1)
    assert len(got) == len(p) and all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))


def test_nearest_without_features(spark):
    pts = frame(spark, x=[1.0], y=[2.0])
    none = spark.createDataFrame([], "fx double, fy double")
    assert sp.nearest_feature(pts, none).first()["distance"] is None


@pytest.mark.parametrize("stop", [500, 2e7])
def test_pair_median_with_copies(spark, stop):
    p = clustered(5, 201)
    i, j = np.triu_indices(len(p), 1)
    want = np.median(np.hypot(*(p[i] - p[j]).T))
    r = sp.pair_distance_median(frame(spark, x=p[:, 0], y=p[:, 1]), stop_at=stop).first()
    assert r["n_pairs"] == len(i) and r["median_distance"] == pytest.approx(want, rel=1e-12)


def test_pair_median_of_few_points(spark):
    assert sp.pair_distance_median(frame(spark, x=[1.0], y=[1.0])).first()["median_distance"] is None
    assert sp.pair_distance_median(frame(spark, x=[0.0, 3.0], y=[0.0, 4.0])).first()["median_distance"] == 5.0


@pytest.mark.parametrize("block", [5, 1024])
def test_semivariogram_with_hot_cell(spark, block):
    p = clustered(7, 240)
    z = np.random.default_rng(8).normal(size=len(p))
    got = {r["lag"]: r for r in sp.semivariogram(frame(spark, x=p[:, 0], y=p[:, 1], z=z), "z", 200.0, 20.0, block=block).collect()}
    i, j = np.triu_indices(len(p), 1)
    d = np.hypot(*(p[i] - p[j]).T)
    ok = d <= 200.0
    lag = np.minimum((d[ok] // 20).astype(int), 9)
    s = 0.5 * (z[i] - z[j])[ok] ** 2
    assert set(got) == set(lag)
    for k in set(lag):
        assert got[k]["np"] == (lag == k).sum()
        assert got[k]["dist"] == pytest.approx(d[ok][lag == k].mean()) and got[k]["gamma"] == pytest.approx(s[lag == k].mean())


def test_projection_reference_points(spark):
    df = spark.createDataFrame([(0.0, -111.0), (48.6, -111.0), (48.6, -113.9)], "lat double, lon double")
    e, n = pj.to_utm("lat", "lon", 12)
    lat, lon = pj.to_lat_lon("e", "n", 12)
    rows = df.withColumns({"e": e, "n": n}).withColumns({"lat2": lat, "lon2": lon}).collect()
    assert rows[0]["e"] == pytest.approx(500000.0) and rows[0]["n"] == pytest.approx(0.0, abs=1e-6)
    # Scaled meridian arc length at 48.6 degrees north.
    assert rows[1]["e"] == pytest.approx(500000.0) and rows[1]["n"] == pytest.approx(5382753.6, abs=400)
    for r in rows:
        assert r["lat2"] == pytest.approx(r["lat"], abs=1e-9) and r["lon2"] == pytest.approx(r["lon"], abs=1e-9)


def test_mask_square_and_resample_identity(spark):
    grid = ra.Grid(0.0, 10.0, 1.0, 10, 10)
    cells = plane(spark, 10, lambda i, j: i + 10 * j)
    ring = [(2.0, 2.0), (7.0, 2.0), (7.0, 5.0), (2.0, 5.0)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "x1 double, y1 double, x2 double, y2 double")
    got = {(r["row"], r["col"]) for r in ra.mask(cells, edges, grid).collect()}
    assert got == {(i, j) for i in range(5, 8) for j in range(2, 7)}
    same = {tuple(r) for r in ra.resample(cells, grid, grid, lambda x, y: (x, y)).collect()}
    assert same == {tuple(r) for r in cells.select("row", "col", "value").collect()}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_product_joins_in_plans(spark):
    pts = frame(spark, id=range(50), x=np.arange(50.0), y=np.arange(50.0) ** 1.5, z=np.ones(50))
    feats = pts.select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    for df in (sp.nearest_feature(pts, feats), sp.semivariogram(pts, "z", 20.0, 2.0), ra.terrain(plane(spark, 4, lambda i, j: i), 1.0)):
        assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)


def test_dominant_prunes_before_the_shuffle(spark):
    from regrove.operators.grouping import dominant
    assert "WindowGroupLimit" in plan(dominant(frame(spark, k=["a", "b"], w=[1.0, 2.0]), ["k"], "w"))
