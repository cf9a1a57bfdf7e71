"""Cases beyond former limits: far quantiles, many levels, counts without overdispersion, empty samples, any column order."""

import math

import numpy as np
import pytest

from regrove.functions import tails
from regrove.operators import glm, hypothesis as hy, joins as jn, ordered, raster, selection as sel
from regrove.sources import readers, writers


def test_far_quantiles_and_many_degrees_of_freedom():
    assert tails.student_quantile(0.0001, 1) == pytest.approx(math.tan(math.pi * (0.5 - 0.0001)), rel=1e-9)
    assert tails.student_p(1.96, 1e12) == pytest.approx(tails.normal_p(1.96), rel=1e-9)
    q = tails.tukey_quantile(0.01, 20, 1)
    assert q > 100 and tails.tukey_p(q, 20, 1) == pytest.approx(0.01, rel=1e-6)
    assert tails.tukey_p(3.5, 3, 24_999) == pytest.approx(tails.tukey_p(3.5, 3, 25_001), rel=1e-6)
    assert tails.tukey_p(3.3, 2, 40) == pytest.approx(tails.student_p(3.3 / math.sqrt(2), 40), rel=1e-6)
    assert tails.beta_inc(3, 2, 0.4) == pytest.approx(0.1792)


def test_letters_do_not_run_out(spark):
    assert [hy.letter_code(i) for i in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]
    rows = [(f"g{g:02d}", 100.0 * g + e) for g in range(30) for e in (-0.1, 0.0, 0.1)]
    got = {r.g: r.letters for r in hy.letters(spark.createDataFrame(rows, "g string, v double"), [], "g", "v").collect()}
    assert len(got) == 30 and len(set(got.values())) == 30 and all(got.values())


def test_compact_letters_tell_exactly_the_differing_pairs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 8))
        apart = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        held = [set(x) for x in hy.compact_letters(list(range(n)), apart)]
        for a in range(n):
            for b in range(a + 1, n):
                assert (not held[a] & held[b]) == ((a, b) in apart)


def test_counts_without_overdispersion_keep_their_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = np.round(np.exp(1.5 + 0.3 * x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, x, rng.normal(size=300))], "y double, a double, b double")
    subsets = sel.term_subsets(spark, ["a", "b"], 1, 2)
    fit = sel.fit_subsets(df, "y", subsets)
    ranked = sel.ranked_models(fit.summary()).collect()
    assert len(ranked) == 3 and all(r.status == "poisson limit" and r.theta == math.inf and r.weight is not None for r in ranked)
    plain = glm.fit_models(df, [glm.Model("p", "y", ("a",), "poisson")]).summary().first()
    assert next(r for r in ranked if r.terms == "a").loglik == pytest.approx(plain.loglik)


def test_every_requested_model_has_a_row(spark):
    df = spark.createDataFrame([(0.0, 1.0, "p"), (0.0, 2.0, "p"), (0.0, 3.0, "p")], "y double, x double, g string")
    fit = glm.fit_models(df, [glm.Model("zero", "y", ("x",)), glm.Model("none", "y", ("x",), group="q")], "g")
    got = {r.model_id: r for r in fit.summary().collect()}
    assert got["zero"].status == "all responses zero" and got["none"].status == "no rows" and not got["zero"].converged
    assert fit.coefficients().filter("estimate is null").count() == 4


def test_subsets_of_many_terms(spark):
    terms = [f"t{i}" for i in range(30)]
    mask = spark.createDataFrame([("t0", "t1", False)], "var1 string, var2 string, allowed boolean")
    assert sel.term_subsets(spark, terms, 1, 2, mask).count() == 30 + 435 - 1


def test_a_missing_sample_spoils_one_key_only(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 1.0), ("b", "y", 3.0)], "k string, g string, v double")
    got = {r.k: r for r in hy.ks_two_sample(df, ["k"], "g", "v", "x", "y").collect()}
    assert got["a"].d is None and got["a"].p is None and got["b"].d == 1.0
    assert hy.ks_two_sample(df, ["k"], "g", "v", "x", "y", exact=True).filter("k = 'b'").first().p == pytest.approx(1.0)


def test_large_whole_numbers_keep_their_ranks(spark):
    df = spark.createDataFrame([((1 << 60) + i,) for i in (0, 1, 1, 2)], "v long")
    assert sorted(r.rank_v for r in ordered.tie_ranks(df, [], "v").collect()) == [1.0, 2.5, 4.0]


def test_csv_columns_bind_by_name(spark, tmp_path):
    writers.save_csv(spark.createDataFrame([(1, 10)], "a int, b int"), f"{tmp_path}/x")
    writers.save_csv(spark.createDataFrame([(20, 2)], "b int, a int"), f"{tmp_path}/y")
    got = readers.csv_tables(spark, [f"{tmp_path}/x", f"{tmp_path}/y"], "a int, b int, c string").collect()
    assert sorted(map(tuple, got)) == [(1, 10, None), (2, 20, None)]


def test_overlapping_polygons_add_up(spark):
    grid = raster.Grid(0.0, 10.0, 1.0, 10, 10)
    cells = spark.range(100).selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "1.0D as value")
    square = lambda k, a, b: [(k, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    edges = readers.polygon_edges(spark.createDataFrame(square(1, 1, 5) + square(2, 3, 7), "poly_id int, ring int, seq int, x double, y double"))
    assert raster.mask(cells, edges, grid).count() == 28


def test_joins_without_keys_take_one_row(spark):
    a, b = spark.range(3).toDF("x"), spark.createDataFrame([(7, "z")], "width int, note string")
    joined = jn.natural_inner(a, b, [])
    assert sorted(map(tuple, joined.collect())) == [(0, 7, "z"), (1, 7, "z"), (2, 7, "z")]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert jn.natural_inner(a, b.limit(0), []).count() == 0 and jn.natural_left(a, b.limit(0), []).count() == 3
    with pytest.raises(ValueError):
        jn.natural_inner(a, a.withColumnRenamed("x", "y"), [])


def test_residual_degrees_of_an_intercept_only_model(spark):
    rows = [(float(v),) for v in (0, 1, 1, 2, 3, 0, 5, 2, 1, 4)]
    fit = glm.fit_models(spark.createDataFrame(rows, "y double"), [glm.Model("m", "y", (), "poisson")])
    r = glm.overdispersion(fit.summary()).first()
    assert r.df_residual == 9 and r.chat == pytest.approx(r.pearson / 9)
