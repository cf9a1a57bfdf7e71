"""Work of the dual descents grows clearly slower than the pairs, and results stay exact."""

import numpy as np
import pytest

from regrove.operators import spatial as sp


def table(spark, **columns):
    return spark.createDataFrame(list(zip(*[np.asarray(c, float).tolist() for c in columns.values()])), ", ".join(f"{c} double" for c in columns))


def test_semivariogram_from_moments(spark):
    met = []
    for n in (1500, 6000):
        rng = np.random.default_rng(n)
        p, z, work = rng.random((n, 2)) * 100, rng.normal(size=n), []
        got = {r["lag"]: r for r in sp.semivariogram(table(spark, x=p[:, 0], y=p[:, 1], z=z), "z", 60.0, 20.0, block=4, work=work).collect()}
        met.append(sum(work))
        i, j = np.triu_indices(n, 1)
        d = np.hypot(*(p[i] - p[j]).T)
        for k in range(3):
            here = (d // 20 == k) & (d <= 60)
            assert got[k]["np"] == here.sum()
            assert got[k]["dist"] == pytest.approx(d[here].mean(), rel=1e-6)
            assert got[k]["gamma"] == pytest.approx((0.5 * (z[i] - z[j])[here] ** 2).mean())
    assert met[1] < 11 * met[0] and met[1] < 0.35 * 6000 * 6000 / 2


def test_nearest_candidates_are_near_linear(spark):
    kept = []
    for n in (800, 3200):
        rng = np.random.default_rng(n)
        p, f, work = rng.random((n, 2)) * 100, rng.random((n, 2)) * 100, []
        got = sp.nearest_feature(table(spark, x=p[:, 0], y=p[:, 1]), table(spark, fx=f[:, 0], fy=f[:, 1]), leaf_points=4, work=work).collect()
        want = {tuple(a): np.hypot(*(f - a).T).min() for a in p.tolist()}
        assert all(r["distance"] == pytest.approx(want[r["x"], r["y"]]) for r in got) and len(got) == n
        kept.append(sum(work))
    assert kept[1] < 6 * kept[0]
    apart = []
    sp.nearest_feature(table(spark, x=p[:, 0], y=p[:, 1]), table(spark, fx=f[:, 0] + 500, fy=f[:, 1]), leaf_points=4, work=apart).count()
    assert sum(apart) < 12 * 3200
