"""Statistics of all distances, met block by block: exact over many blocks, and nothing is written per pair."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from regrove.operators import spatial as sp


def places(n, seed):
    """A third of them on a few spots, a third close together, a third far apart."""
    rng = np.random.default_rng(seed)
    p = np.vstack([rng.integers(0, 4, (n // 3, 2)) * 25.0, rng.normal([60, 40], 0.5, (n // 3, 2)), rng.uniform(0, 100, (n - 2 * (n // 3), 2))])
    return p, rng.normal(size=n)


def table(spark, p, z):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(p, z)], "x double, y double, z double")


def distances(p):
    i, j = np.triu_indices(len(p), 1)
    return i, j, np.hypot(*(p[i] - p[j]).T)


@pytest.fixture
def small_blocks(monkeypatch):
    from regrove.operators import blocks
    monkeypatch.setattr(blocks, "block_size", lambda n: 100)


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written on the way."""
    rows, before = [], DataFrame.checkpoint

    def counted(df, *args, **named):
        out = before(df, *args, **named)
        rows.append(out.count())
        return out
    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    return rows


def test_pair_median_writes_no_pairs(spark, written):
    p, z = places(1500, 3)
    r = sp.pair_distance_median(table(spark, p, z), stop_at=1000).first()
    assert r["n_pairs"] == 1500 * 1499 // 2 and r["median_distance"] == pytest.approx(np.median(distances(p)[2]), rel=1e-12)
    assert max(written) < 10 * 1500


@pytest.mark.parametrize("stop", [100, 2e7])
def test_pair_median_over_blocks(spark, small_blocks, stop):
    p, z = places(901, 4)
    r = sp.pair_distance_median(table(spark, p, z), stop_at=stop).first()
    assert r["median_distance"] == pytest.approx(np.median(distances(p)[2]), rel=1e-12)


def test_pair_median_of_two_distances(spark):
    """The middle lies between two distances, each of a million and more pairs."""
    p = np.repeat([[0.0, 0.0], [3.0, 4.0]], [1500, 1499], axis=0)
    p = np.vstack([p, [[0.0, 1000.0]]])
    r = sp.pair_distance_median(table(spark, p, np.zeros(len(p))), stop_at=10).first()
    assert r["median_distance"] == np.median(distances(p)[2])


def lag_sums(p, z, cutoff, width):
    i, j, d = distances(p)
    last = round(cutoff / width) - 1
    for k in range(last + 1):
        here = (d <= cutoff) & (np.minimum(d // width, last) == k)
        if here.any():
            yield k, here.sum(), d[here].mean(), (0.5 * (z[i] - z[j])[here] ** 2).mean()


def test_semivariogram_writes_no_pairs(spark, written):
    p, z = places(1500, 5)
    got = sp.semivariogram(table(spark, p, z), "z", 50.0, 1.0, block=4).collect()
    assert sorted((r["lag"], r["np"]) for r in got) == [(k, n) for k, n, _, _ in lag_sums(p, z, 50.0, 1.0)]
    assert max(written) < 10 * 1500


@pytest.mark.parametrize("cutoff, width, block", [(45.0, 5.0, 64), (120.0, 40.0, 8), (12.0, 4.0, 2)])
def test_semivariogram_over_blocks(spark, small_blocks, cutoff, width, block):
    p, z = places(901, 6)
    got = {r["lag"]: r for r in sp.semivariogram(table(spark, p, z), "z", cutoff, width, block=block).collect()}
    want = list(lag_sums(p, z, cutoff, width))
    assert sorted(got) == [w[0] for w in want]
    for k, n, dist, gamma in want:
        assert got[k]["np"] == n and got[k]["dist"] == pytest.approx(dist, rel=1e-6) and got[k]["gamma"] == pytest.approx(gamma)
