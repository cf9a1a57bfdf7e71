"""Tests, community statistics and models against tables, identities and brute force."""

import math
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrove.functions import special as sf, tails
from regrove.operators import community as cm, hypothesis as hy, regression as rg, selection as sel, summaries as sm
from regrove.operators.glm import Model, count_checks, fit_models, likelihood_r2, with_null_models


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_tail_tables():
    assert tails.student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.fisher_p(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.student_quantile(0.025, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.tukey_quantile(0.05, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert tails.tukey_quantile(0.05, 5, 20) == pytest.approx(4.232, abs=2e-3)
    assert tails.tukey_p(2.5 * math.sqrt(2), 2, 17) == pytest.approx(tails.student_p(2.5, 17), abs=1e-7)


def test_exact_ks_small_sample():
    # Complete separation of 3 and 3: 2 of 20 orderings.
    assert tails.ks_exact_p(1.0, 3, 3) == pytest.approx(0.1)
    assert tails.ks_exact_p(1 / 3, 3, 3) == pytest.approx(1.0)


def test_gamma_functions():
    x = np.array([0.01, 0.5, 1.0, 3.7, 25.0, 4000.0])
    assert np.allclose(sf.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    h = 1e-5
    assert np.allclose(sf.digamma(x[1:]), (sf.log_gamma(x[1:] + h) - sf.log_gamma(x[1:] - h)) / (2 * h), rtol=1e-6, atol=1e-6)
    assert sf.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi ** 2 / 6, rel=1e-12)


def test_anova_decomposes_total(spark):
    rng = np.random.default_rng(0)
    g, y = np.repeat(["a", "b", "c"], 20), rng.normal(size=60) + np.repeat([0, 1, 2], 20)
    r = hy.anova(frame(spark, g=g, y=y), [], "g", "y").first()
    assert r["ss_between"] + r["ss_within"] == pytest.approx(((y - y.mean()) ** 2).sum())
    assert (r["df_between"], r["df_within"]) == (2, 57)


def test_letters_share_and_separate(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 1, 30), rng.normal(0.2, 1, 30), rng.normal(5, 1, 30)])
    got = {r["g"]: r["letters"] for r in hy.letters(frame(spark, g=np.repeat(["x", "y", "z"], 30), y=y), [], "g", "y").collect()}
    assert got == {"x": "a", "y": "a", "z": "b"}


def test_overlapping_letters(spark):
    base = np.array([-1.0, 1.0] * 15)
    y = np.concatenate([base, base + 0.5, base + 1.0])
    got = {r["g"]: r["letters"] for r in hy.letters(frame(spark, g=np.repeat(["x", "y", "z"], 30), y=y), [], "g", "y").collect()}
    assert got == {"x": "a", "y": "ab", "z": "b"}


def test_ks_of_equal_samples_is_zero(spark):
    v = np.arange(20.0)
    r = hy.ks_two_sample(frame(spark, g=["a"] * 20 + ["b"] * 20, v=np.concatenate([v, v])), [], "g", "v", "a", "b").first()
    assert r["d"] == 0.0 and r["p"] == pytest.approx(1.0)


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    df = frame(spark, x=x, y=y)
    assert hy.spearman(df, [], "x", "y").first()["rho"] == pytest.approx(want)
    assert hy.spearman_matrix(df, ["y", "x"]).first()["rho"] == pytest.approx(want)


def test_bootstrap_repeats_under_any_partitioning(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, id=range(500), g=["a", "b"] * 250, v=rng.normal(10, 2, 500))
    run = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                           for r in hy.bootstrap_mean(d, ["g"], "v", ["id"], reps=300).collect())
    a = run(df.repartition(1))
    assert a == run(df.repartition(5, "v"))
    for g, mean, lo, hi, n in a:
        assert lo < mean < hi and n == 250 and (hi - lo) == pytest.approx(2 * 1.96 * 2 / math.sqrt(250), rel=0.25)


def test_linear_model_and_interaction(spark):
    rng = np.random.default_rng(5)
    n = 200
    x, s = rng.normal(size=n), rng.integers(0, 2, n)
    y = 1 + 2 * x + 0.5 * s - x * s + rng.normal(0, 0.1, n)
    df, main, cross = rg.interaction_terms(frame(spark, x=x, s=np.where(s == 1, "b", "a"), y=y), "x", "s", ["a", "b"])
    got = {r["term"]: r for r in rg.linear_model(df, "y", main + cross).collect()}
    design = np.column_stack([np.ones(n), x, s, x * s])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [got[t]["estimate"] for t in ("(Intercept)", "x", "sb", "x:sb")] == pytest.approx(list(beta))
    assert rg.nested_f(df, "y", ["x"], main[1:] + cross).first()["p"] < 1e-6


SP = ["a", "b", "c", "d"]


def random_sites(spark, n=60, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(i, "g1" if i < n // 2 else "g2", s, 1.0) for i in range(n) for k, s in enumerate(SP)
            if rng.random() < (0.3 + 0.15 * k if i < n // 2 else 0.75 - 0.15 * k)]
    return rows, spark.createDataFrame(rows, "site int, grp string, sp string, v double")


def test_anosim_equals_brute_force(spark):
    rows, df = random_sites(spark)
    sites = cm.site_patterns(df, ["site", "grp"], "sp", SP, "v")
    sets = {}
    for i, g, s, _ in rows:
        sets.setdefault((i, g), set()).add(s)
    keys = list(sets)
    d, within = [], []
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            u, w = sets[keys[a]], sets[keys[b]]
            d.append(round(1 - 2 * len(u & w) / (len(u) + len(w)), 12))
            within.append(keys[a][1] == keys[b][1])
    rank, within = pd.Series(d).rank().to_numpy(), np.array(within)
    want = (rank[~within].mean() - rank[within].mean()) / (len(d) / 2)
    r = cm.anosim(sites, "grp", permutations=199).first()
    assert r["r"] == pytest.approx(want) and r["n_sites"] == len(keys) and 0 < r["p"] <= 0.05 and r["permutations"] == 199


def test_change_dissimilarity_edge_cases(spark):
    rows = [("same", "pre", "a", 3.0), ("same", "post", "a", 3.0), ("apart", "pre", "a", 2.0), ("apart", "post", "b", 2.0),
            ("once", "pre", "a", 1.0), ("never", "pre", "a", 0.0)]
    df = spark.createDataFrame(rows, "plot string, time string, sp string, v double")
    got = {r["plot"]: r["bray"] for r in cm.change_dissimilarity(df, ["plot"], "time", "pre", "post", "sp", SP, "v").collect()}
    assert got == {"same": 0.0, "apart": 1.0, "once": None}


def test_nmds_is_repeatable_and_recovers_structure(spark):
    _, df = random_sites(spark)
    sites = cm.site_patterns(df, ["site", "grp"], "sp", SP, "v")
    a, b = (sorted(tuple(r) for r in cm.nmds(sites, starts=8).collect()) for _ in range(2))
    assert a == b and 0 <= a[0][-1] < 0.25
    c = {r["grp"]: r["nmds1_mean"] for r in cm.group_centroids(cm.site_scores(sites, cm.nmds(sites, starts=8)), ["grp"]).collect()}
    assert abs(c["g1"] - c["g2"]) > 0.3


def test_too_many_species_is_refused(spark):
    with pytest.raises(ValueError):
        cm.site_patterns(spark.range(1), ["id"], "id", [str(i) for i in range(13)])


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(9)
    n = 3000
    x1, x2, x3 = rng.normal(size=(3, n))
    mu = np.exp(1.0 + 0.5 * x1 - 0.3 * x2)
    y = rng.poisson(rng.gamma(2.0, mu / 2.0))
    return pd.DataFrame({"id": np.arange(n), "y": y.astype(float), "p": rng.poisson(mu).astype(float), "x1": x1, "x2": x2, "x3": x3})


def brute_ll(beta, theta, y, x):
    mu = np.exp(x @ beta)
    return (sf.log_gamma(y + theta) - sf.log_gamma(np.array([theta])) - sf.log_gamma(y + 1) + theta * np.log(theta / (mu + theta))
            + y * np.log(mu / (mu + theta))).sum()


def test_negative_binomial_fit_is_a_maximum(spark, counts):
    df = spark.createDataFrame(counts)
    fit = fit_models(df, with_null_models([Model("m", "y", ("x1", "x2"))]))
    s = {r["model_id"]: r for r in fit.summary().collect()}
    c = {r["term"]: r for r in fit.coefficients().filter("model_id = 'm'").collect()}
    beta = np.array([c[t]["estimate"] for t in ("(Intercept)", "x1", "x2")])
    x, y = np.column_stack([np.ones(len(counts)), counts.x1, counts.x2]), counts.y.to_numpy()
    top = brute_ll(beta, s["m"]["theta"], y, x)
    assert s["m"]["loglik"] == pytest.approx(top) and s["m"]["converged"]
    for k in range(3):
        for e in (-1e-3, 1e-3):
            b = beta.copy()
            b[k] += e
            assert brute_ll(b, s["m"]["theta"], y, x) < top
    assert brute_ll(beta, s["m"]["theta"] * 1.01, y, x) < top and brute_ll(beta, s["m"]["theta"] * 0.99, y, x) < top
    assert s["m"]["theta"] == pytest.approx(2.0, rel=0.2) and beta == pytest.approx([1.0, 0.5, -0.3], abs=0.1)
    r2 = likelihood_r2(fit.summary()).first()
    assert 0 < r2["r2_raw"] < r2["r2"] < 1


def test_large_theta_approaches_poisson(spark, counts):
    df = spark.createDataFrame(counts)
    fit = fit_models(df, [Model("p", "p", ("x1",), "poisson"), Model("nb", "p", ("x1",), "negbin", 1e7)])
    c = {(r["model_id"], r["term"]): r["estimate"] for r in fit.coefficients().collect()}
    assert c["p", "x1"] == pytest.approx(c["nb", "x1"], abs=1e-5)


def test_poisson_score_equations(spark, counts):
    df = spark.createDataFrame(counts)
    fit = fit_models(df, [Model("p", "p", ("x1", "x2"), "poisson")])
    r = fit.fitted(df, "p").agg(F.sum(F.col("p") - F.col("mu")), F.sum((F.col("p") - F.col("mu")) * F.col("x1"))).first()
    assert abs(r[0]) < 1e-3 and abs(r[1]) < 1e-3


def test_simulation_checks_accept_the_true_model(spark, counts):
    df = spark.createDataFrame(counts)
    fit = fit_models(df, [Model("m", "y", ("x1", "x2"))])
    a = {r["check"]: r for r in count_checks(fit, df, "m", ["id"], sims=100).collect()}
    assert a["dispersion"]["ratio"] == pytest.approx(1.0, abs=0.2) and a["zero_inflation"]["ratio"] == pytest.approx(1.0, abs=0.2)
    assert a["uniform_residuals"]["p"] > 1e-3
    b = {r["check"]: r for r in count_checks(fit, df.repartition(3), "m", ["id"], sims=100).collect()}
    assert all(a[k]["p"] == b[k]["p"] for k in a)
    copies = count_checks(fit, df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))), "m", ["id"], sims=60)  # three of every row
    assert {r["check"]: r for r in copies.collect()}["dispersion"]["ratio"] == pytest.approx(1.0, abs=0.2)


def test_all_subsets_and_average(spark, counts):
    df = spark.createDataFrame(counts)
    mask = spark.createDataFrame([("x1", "x3", False)], "var1 string, var2 string, allowed boolean")
    subs = sel.term_subsets(spark, ["x1", "x2", "x3"], 1, 2, mask)
    assert {r["terms"] for r in subs.collect()} == {"x1", "x2", "x3", "x1,x2", "x2,x3"}
    fit = sel.fit_subsets(df, "y", subs)
    ranked = sel.ranked_models(fit.summary())
    assert ranked.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert ranked.orderBy("delta").first()["terms"] == "x1,x2"
    avg = {r["term"]: r for r in sel.average_models(ranked, fit.coefficients()).collect()}
    one = {r["term"]: r for r in fit.coefficients().filter("model_id like '%#3'").collect()}
    assert avg["x1"]["estimate"] == pytest.approx(one["x1"]["estimate"]) and avg["x1"]["se"] == pytest.approx(one["x1"]["se"])
    assert avg["x1"]["signif"] == 1
    part = {r["term"]: r["partial_r2"] for r in sel.leave_one_out(df, Model("m", "y", ("x1", "x2"))).collect()}
    assert part["x1"] > part["x2"] > 0


def test_effect_table_clamps_then_builds_intervals(spark):
    c = spark.createDataFrame([("(Intercept)", 1.0, 0.1, 0.0), ("OM", -25.0, 3.0, 0.01), ("vpd", 1.0, 0.5, None)], "term string, estimate double, se double, p double")
    got = {r["term"]: r for r in sel.effect_table(c, {"OM": "Soil"}, {"OM": "Soil OM", "vpd": "VPD"}).collect()}
    assert set(got) == {"Soil OM", "VPD"}
    assert got["Soil OM"]["estimate"] == -10.0 and got["Soil OM"]["ci_min"] == -11.0 and got["Soil OM"]["ci_max"] == pytest.approx(-4.12)
    assert got["Soil OM"]["signif"] == 1 and got["VPD"]["signif"] is None and got["VPD"]["type"] is None


def test_z_scores(spark):
    r = sm.z_scores(frame(spark, x=[1.0, 2.0, 3.0, 6.0]), ["x"]).agg(F.avg("x"), F.stddev_samp("x")).first()
    assert r[0] == pytest.approx(0.0) and r[1] == pytest.approx(1.0)


def test_model_queries_cover_every_flag_and_subset(spark):
    import itertools
    from regrove.registry import modelling
    folder = "/root/testdata/sf0.001"
    mask = hy.independence_mask(hy.spearman_matrix(modelling._design(spark, folder), modelling._PREDICTORS))
    bad = [{r["var1"], r["var2"]} for r in mask.filter("not allowed").collect()]
    want = {(f, ",".join(c)) for f in "ANR" for n in range(1, 6) for c in itertools.combinations(modelling._PREDICTORS, n)
            if not any(b <= set(c) for b in bad)}
    ranked = modelling.subset_ranking(spark, folder).collect()
    assert {(r["model_group"], r["terms"]) for r in ranked} == want and len(ranked) == len(want)
    for f in "ANR":
        mine = [r for r in ranked if r["model_group"] == f]
        assert sum(r["weight"] for r in mine) == pytest.approx(1.0, abs=0.01) and min(r["delta"] for r in mine) == 0
    assert {r["model_group"] for r in modelling.model_average(spark, folder).collect()} == set("ANR")
    assert {r["model_group"] for r in modelling.averaged_effects(spark, folder).collect()} == set("ANR")
    assert sorted(r["model_id"] for r in modelling.nb_checks(spark, folder).collect()) == sorted("ANR" * 3)


def test_small_rank_law_against_all_orderings():
    for n in range(2, 9):
        middle = (n ** 3 - n) / 6
        found = Counter(sum((i - p) ** 2 for i, p in enumerate(order)) for order in permutations(range(n)))
        for s in found:
            side = sum(v for k, v in found.items() if (k >= s if s > middle else k <= s)) / math.factorial(n)
            assert tails.spearman_small_p(1 - s / middle, n) == pytest.approx(min(1.0, 2 * side), abs=1e-12)


def test_rank_series_is_near_the_counted_law():
    counted = tails._rank_distance_tail(11)
    assert max(abs(counted[s] - tails._rank_distance_upper(s, 11)) for s in range(0, 440, 2)) < 5e-4


def test_small_sample_spearman_by_group(spark):
    groups = {"few": ([1, 2, 3, 4, 5], [1, 3, 2, 5, 4]), "tied": ([1, 2, 2, 4, 5], [1, 3, 2, 5, 4]), "one": ([1], [1]),
              "more": (list(range(20)), [(7 * i) % 20 for i in range(20)])}
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)] + [("few", 9.0, None), (None, 1.0, 2.0), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    small = {r["g"]: r for r in hy.spearman(df, ["g"], "x", "y", small_sample=True).collect()}
    usual = {r["g"]: r for r in hy.spearman(df, ["g"], "x", "y").collect()}
    assert (small["few"]["n"], small["few"]["rho"]) == (5, pytest.approx(0.8))
    assert small["few"]["p"] == pytest.approx(16 / 120)         # 8 of 120 orderings lie within a distance of 4
    assert small["tied"]["p"] == usual["tied"]["p"]
    assert small["more"]["p"] == pytest.approx(usual["more"]["p"], abs=0.01) and small["more"]["p"] != usual["more"]["p"]
    assert small["one"]["p"] is None and small[None]["p"] == pytest.approx(1.0)
    assert hy.spearman(df.limit(0), ["g"], "x", "y", small_sample=True).count() == 0
