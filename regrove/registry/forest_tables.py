"""Forest-structure queries: suppliers and users stand in for plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ecology as eco, missing as ms
from ..operators import forest, grouping as gp
from ..operators.reshape import cast_wide
from ..plans import survey
from .base import R, out, query, read

_TYPES = ["click", "error", "purchase", "signup", "view"]
_SPLIT = "2024-01-16"

_SPECIES_SQL = """s AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS basal FROM events GROUP BY 1, 2),
i AS (SELECT *, sum(n) OVER w AS site_count, sum(basal) OVER w AS site_basal,
 n / sum(n) OVER w + basal / sum(basal) OVER w AS impval FROM s WINDOW w AS (PARTITION BY user_id))"""


def _user_species(spark, d):
    s = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("basal"))
    return forest.with_importance(s, ["user_id"], "n", "basal")


@query(f"""WITH {_SPECIES_SQL} SELECT user_id, event_type, n, CAST(site_count AS BIGINT) AS site_count, {R('basal', 4)} AS basal,
 {R('site_basal', 4)} AS site_basal, {R('impval')} AS impval FROM i""")
def importance_value(spark, d):
    return out(_user_species(spark, d), "user_id", "event_type", "n", "site_count", "basal", "site_basal", "impval",
               basal=4, site_basal=4)


@query(f"""WITH {_SPECIES_SQL} SELECT user_id, event_type, {R('impval')} AS impval FROM
 (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY impval DESC) AS r FROM i WHERE impval IS NOT NULL) WHERE r = 1""")
def dominant_species(spark, d):
    return out(gp.dominant(_user_species(spark, d), ["user_id"], "impval"), "user_id", "event_type", "impval")


_TREES_SQL = """t AS (SELECT l_suppkey AS plot, l_linestatus AS season, 1 + l_suppkey % 4 AS n_quads,
 CASE WHEN l_returnflag = 'N' THEN 'THPL' ELSE l_returnflag END AS sp, l_extendedprice / 100 AS dbh,
 CASE WHEN l_discount > 0.05 THEN 1 WHEN l_discount > 0.02 THEN 0 END AS cones,
 CASE WHEN l_tax > 0.04 THEN 1 WHEN l_tax > 0.01 THEN 0 END AS serotinous FROM lineitem WHERE l_quantity <> 50)"""


def _trees(spark, d):
    return read(spark, d, "lineitem").filter("l_quantity <> 50").select(
        F.col("l_suppkey").alias("plot"), F.col("l_linestatus").alias("season"),
        (1 + F.col("l_suppkey") % 4).alias("n_quads"), ms.recode("l_returnflag", "N", "THPL").alias("sp"),
        (F.col("l_extendedprice") / 100).alias("dbh"),
        F.when(F.col("l_discount") > 0.05, 1).when(F.col("l_discount") > 0.02, 0).alias("cones"),
        F.when(F.col("l_tax") > 0.04, 1).when(F.col("l_tax") > 0.01, 0).alias("serotinous"))


@query(f"""WITH {_TREES_SQL}, g AS (SELECT plot, season, n_quads, sp, count(*) AS n,
 sum(pi() * pow(dbh / 2000, 2) / (0.07 * n_quads / 4)) AS basal, avg(dbh) AS dbh_mean, CAST(coalesce(sum(cones), 0) AS BIGINT) AS cones,
 CAST(coalesce(sum(serotinous), 0) AS BIGINT) AS serot, count(*) / (0.07 * n_quads / 4) AS dens_ha FROM t GROUP BY 1, 2, 3, 4)
SELECT plot, season, sp, n AS count, {R('basal', 4)} AS basal, {R('dbh_mean', 4)} AS dbh_mean, cones, serot, {R('dens_ha', 4)} AS dens_ha,
 {R('n / sum(n) OVER w + basal / sum(basal) OVER w')} AS impval FROM g WINDOW w AS (PARTITION BY plot)""")
def tree_structure(spark, d):
    s = forest.tree_structure(_trees(spark, d), ["plot", "season"])
    return out(s, "plot", "season", "sp", "count", "basal", "dbh_mean", "cones", "serot", "dens_ha", "impval", digits=4, impval=6)


@query(f"""WITH x AS (SELECT l_suppkey AS plot, l_linestatus AS season, l_returnflag AS sp, coalesce(nullif(l_quantity, 50), 0) AS n,
 (coalesce(CASE WHEN l_suppkey % 3 <> 0 THEN 20.0 + l_suppkey % 10 END, 28.0) + 30.0) * 2 AS area FROM lineitem),
g AS (SELECT plot, season, sp, sum(area) AS area_m2, sum(n) AS n, sum(n / area * 10000) AS dens_ha FROM x GROUP BY 1, 2, 3)
SELECT plot, season, sp, {R('area_m2', 4)} AS area_m2, {R('n', 4)} AS count, {R('dens_ha', 3)} AS dens_ha, CAST(0 AS DOUBLE) AS basal,
 {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY plot), 0), 0)')} AS impval FROM g""")
def seedling_structure(spark, d):
    x = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("plot"), F.col("l_linestatus").alias("season"), F.col("l_returnflag").alias("sp"),
        F.nullif("l_quantity", F.lit(50.0)).alias("count"),
        F.when(F.col("l_suppkey") % 3 != 0, F.lit(20.0) + F.col("l_suppkey") % 10).alias("t1_length"), F.lit(30.0).alias("t2_length"))
    return out(forest.seedling_structure(x, ["plot", "season"]), "plot", "season", "sp", "area_m2", "count", "dens_ha",
               "basal", "impval", area_m2=4, count=4, dens_ha=3)


_COVER_SQL = "CASE WHEN NOT (l_quantity = 50 AND l_tax = 0.08) THEN l_discount * 100 END"


@query("WITH x AS (SELECT l_suppkey, l_linestatus, l_returnflag AS k, " + _COVER_SQL + " AS c FROM lineitem) SELECT l_suppkey, l_linestatus, "
       + ", ".join(R(f"CASE WHEN count(c) FILTER (k = '{k}') = count(*) FILTER (k = '{k}') THEN avg(c) FILTER (k = '{k}') END") + f" AS {k}"
                   for k in "ANR") + " FROM x GROUP BY 1, 2")
def cover_by_type(spark, d):
    x = read(spark, d, "lineitem").select("l_suppkey", "l_linestatus", F.col("l_returnflag").alias("type"), F.expr(_COVER_SQL).alias("cover"))
    return out(forest.cover_by_type(x, ["l_suppkey", "l_linestatus"], ["A", "N", "R"]))


@query(f"""
SELECT user_id, CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, CAST(sum(n) AS BIGINT) AS n, {R('sum(v)', 4)} AS v
FROM (SELECT user_id, event_type, 1 AS n, value AS v FROM events) GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def totals_beside_species(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", F.lit(1).cast("bigint").alias("n"), F.col("value").alias("v"))
    return out(forest.totals_beside_species(e, ["user_id"], "event_type", ["n", "v"]), digits=4)


_VISITS_SQL = f"""v AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN '2019' ELSE '2020' END AS season, event_type AS sp,
 CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 'pre' ELSE 'post' END AS tm, count(*) AS n, sum(value) AS basal FROM events GROUP BY 1, 2, 3, 4)"""


def _visits(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id", F.when(F.col("user_id") % 2 == 0, "2019").otherwise("2020").alias("season"), F.col("event_type").alias("sp"),
                     F.when(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"), "pre").otherwise("post").alias("tm")).agg(
        F.count("*").alias("n"), F.sum("value").alias("basal"))


def _pre_post(spark, d):
    v = _visits(spark, d)
    pre = v.filter("tm = 'pre'").withColumn("dens_ha", F.col("n") / 0.07).withColumn("serot", F.when(F.col("basal") > 400, 1.0).otherwise(0.0))
    post = v.filter("tm = 'post'").withColumn("dens_ha", F.col("n") * 10.0)
    return pre, post


@query("WITH " + _VISITS_SQL + ", w AS (SELECT user_id, season, " + ", ".join(
    f"coalesce(sum({e}) FILTER (tm = '{t}' AND sp = '{s}'), 0) AS {m}_{s}" for m, t, e in
    (("pre_basal", "pre", "basal"), ("pre_dens_ha", "pre", "n / 0.07"), ("post_dens_ha", "post", "n * 10.0")) for s in _TYPES) + ", " + ", ".join(
    f"coalesce(sum({e}) FILTER (tm = '{t}'), 0) AS {m}_all" for m, t, e in
    (("pre_basal", "pre", "basal"), ("pre_dens_ha", "pre", "n / 0.07"), ("post_dens_ha", "post", "n * 10.0")))
    + ", CASE WHEN coalesce(max(basal) FILTER (tm = 'pre' AND sp = 'click'), 0) > 400 THEN 1 ELSE 0 END AS serot FROM v GROUP BY 1, 2) SELECT user_id, season, serot, "
    + ", ".join(R(f"{m}_{s}", 3) + f" AS {m}_{s}" for m in ("pre_basal", "pre_dens_ha", "post_dens_ha") for s in [*_TYPES, "all"]) + " FROM w")
def plot_features(spark, d):
    pre, post = _pre_post(spark, d)
    return out(forest.plot_features(pre, post, ["user_id", "season"], _TYPES, serotinous_species="click"), digits=3)


_CHANGE_SQL = _VISITS_SQL + """, i AS (SELECT *, n / sum(n) OVER w + basal / sum(basal) OVER w AS imp FROM v WINDOW w AS (PARTITION BY user_id, tm)),
r AS (SELECT *, rank() OVER (PARTITION BY user_id, tm ORDER BY imp DESC) AS r FROM i),
c AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.season, b.season) AS season, a.sp AS pre_sp, b.sp AS post_sp
 FROM (SELECT * FROM r WHERE tm = 'pre' AND r = 1) a FULL JOIN (SELECT * FROM r WHERE tm = 'post' AND r = 1) b
 ON a.user_id = b.user_id AND a.season = b.season)"""


def _change(spark, d):
    v = forest.with_importance(_visits(spark, d), ["user_id", "tm"], "n", "basal").withColumn("dens_ha", F.col("n").cast("double"))
    return forest.dominance_change(v.filter("tm = 'pre'"), v.filter("tm = 'post'"), ["user_id"])


@query(f"WITH {_CHANGE_SQL} SELECT user_id, season, pre_sp, post_sp FROM c")
def dominance_change(spark, d):
    return _change(spark, d)


@query(f"WITH {_CHANGE_SQL} SELECT season, pre_sp, post_sp, count(*) AS n FROM c GROUP BY 1, 2, 3")
def flow_table(spark, d):
    return forest.flow_counts(_change(spark, d))


_ORDER = ["view", "purchase", "click", "error"]  # signup is undeclared: it becomes missing


@query(f"""WITH {_CHANGE_SQL}, l AS (SELECT user_id, season, 'pre_sp' AS time, pre_sp AS s FROM c UNION ALL SELECT user_id, season, 'post_sp', post_sp FROM c),
m AS (SELECT user_id, season, time, CASE WHEN s IN ('view', 'purchase', 'click', 'error') THEN s END AS dom_sp FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, time ORDER BY
 CASE dom_sp WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 ELSE 5 END, season) AS k FROM m)
SELECT season, time, dom_sp, count(*) AS n FROM o WHERE k = 1 GROUP BY 1, 2, 3""")
def dominance_table(spark, d):
    return forest.dominance_table(_change(spark, d), "user_id", "season", _ORDER)


@query("""WITH e AS (SELECT user_id, event_type, count(*) FILTER (value > 200) AS n FROM events GROUP BY 1, 2),
m AS (SELECT user_id, CASE WHEN n = 0 THEN 'None' ELSE event_type END AS sp, CASE WHEN n = 0 THEN 1.0 ELSE CAST(n AS DOUBLE) END AS dens_ha, n FROM e)
SELECT DISTINCT user_id, sp, dens_ha FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM m) WHERE r = 1""")
def empty_plot_state(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("sp")).agg(F.count_if(F.col("value") > 200).alias("n"))
    e = forest.mark_empty(e.withColumn("dens_ha", F.col("n").cast("double")))
    return gp.dominant(e, ["user_id"], "n").select("user_id", "sp", "dens_ha").distinct()


@query(f"""WITH t AS (SELECT l_suppkey AS plot, 1000.0 + 37 * (l_suppkey % 17) AS elev, 1 + l_suppkey % 4 AS q,
 CASE WHEN l_returnflag IN ('A', 'R') THEN 'AR' ELSE l_returnflag END || l_linestatus AS sp, l_extendedprice / 100 AS dbh,
 CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS cones, CASE WHEN l_tax > 0.04 AND l_discount > 0.05 THEN 1 WHEN l_discount > 0.05 THEN 0 END AS ser FROM lineitem),
g AS (SELECT plot, elev, sp, count(*) AS stems, 0.07 * max(q) / 4 AS area, sum(ser) / sum(cones) AS serotiny, avg(dbh) AS mean_dbh,
 avg(pi() * pow(dbh / 2000, 2)) / (0.07 * max(q) / 4) AS basal, round_even(elev / 100, 0) AS elev_class FROM t GROUP BY 1, 2, 3),
c AS (SELECT elev_class, sum(basal) / max(area) AS sb, sum(stems) AS ss FROM g GROUP BY 1),
i AS (SELECT g.*, stems / ss + basal / sb AS impval FROM g JOIN c USING (elev_class))
SELECT plot, sp, elev_class, stems, {R('serotiny')} AS serotiny, {R('mean_dbh', 4)} AS mean_dbh, {R('basal')} AS basal, {R('impval')} AS impval
FROM (SELECT *, rank() OVER (PARTITION BY plot ORDER BY impval DESC) AS r FROM i) WHERE r = 1""")
def elevation_dominance(spark, d):
    grouped = F.concat(ms.collapse("l_returnflag", {"AR": ["A", "R"]}), "l_linestatus")
    t = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("plot"), (F.lit(1000.0) + 37 * (F.col("l_suppkey") % 17)).alias("elev"),
        (1 + F.col("l_suppkey") % 4).alias("n_quads"), grouped.alias("sp"), (F.col("l_extendedprice") / 100).alias("dbh"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("cones"),
        F.when((F.col("l_tax") > 0.04) & (F.col("l_discount") > 0.05), 1).when(F.col("l_discount") > 0.05, 0).alias("serotinous"))
    s = gp.dominant(forest.species_shares_by_class(t, "plot", "elev"), ["plot"], "impval")
    return out(s, "plot", "sp", "elev_class", "stems", "serotiny", "mean_dbh", "basal", "impval", mean_dbh=4)


@query(f"""SELECT l_orderkey, l_linenumber, {R('pi() * pow(l_extendedprice / 100 / 2000, 2) / (0.07 * (1 + l_suppkey % 4) / 4)', 8)} AS basal,
 {R('pi() * pow(l_extendedprice / 1000, 2) / 40000', 8)} AS basal_cm, {R('l_quantity / (0.07 * (1 + l_suppkey % 4) / 4)')} AS stems_ha,
 round_even(l_quantity / (50 * (l_linenumber + 1)) * 10000, 0) AS belt, {R('cos(radians(45.0) - radians(l_extendedprice / 300)) + 1')} AS dev_ne FROM lineitem""")
def plot_formulas(spark, d):
    li = read(spark, d, "lineitem").withColumns({"q": 1 + F.col("l_suppkey") % 4, "dbh": F.col("l_extendedprice") / 100})
    df = li.select("l_orderkey", "l_linenumber", eco.basal_area("dbh", "q").alias("basal"),
                   eco.basal_area_cm(F.col("l_extendedprice") / 1000).alias("basal_cm"), eco.stem_density("l_quantity", "q").alias("stems_ha"),
                   eco.belt_density("l_quantity", F.col("l_linenumber") + 1).alias("belt"),
                   eco.northeastness(F.col("l_extendedprice") / 300).alias("dev_ne"))
    return out(df, basal=8, basal_cm=8)


def _wide_survey(spark, d):
    """Dotted wide export: one row per supplier, counts by transect, age and species."""
    slot = F.concat(F.lit("seedlings_t1.seedlings_t1_n_"), F.when(F.col("l_linestatus") == "F", "t1").otherwise("t2"), F.lit("_"),
                    F.when(F.col("l_linenumber") > 3, "age1").otherwise("older"), F.lit("_"), F.col("l_returnflag"))
    slots = [f"seedlings_t1.seedlings_t1_n_{t}_{a}_{s}" for t in ("t1", "t2") for a in ("age1", "older") for s in "ANR"]
    li = read(spark, d, "lineitem").withColumn("slot", slot).withColumn("n", F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    wide = cast_wide(li, ["l_suppkey"], "slot", slots, ["n"], agg=F.sum)
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey", "s_acctbal")
    return wide.join(s, "l_suppkey").withColumns({
        "plot.name": F.col("s_name"), "plot.utm_easting": F.lit(270000.0) + F.col("s_nationkey"),
        "plot.utm_northing": F.lit(5390000.0) + F.col("l_suppkey"), "phys.phys_elev": F.col("s_acctbal"),
        "seedlings_t1.seedlings_t1_length": F.when(F.col("s_nationkey") > 5, 20.0 + F.col("s_nationkey")),
        "seedlings_t2.seedlings_t2_length": F.lit(None).cast("double")}).drop("s_name", "s_nationkey", "s_acctbal", "l_suppkey")


def _belt_survey(spark, d):
    o = read(spark, d, "orders")
    counts = o.groupBy(F.when(F.col("o_orderstatus") == "P", "RE06").otherwise("RB03").alias("fire"),
                       F.substring("o_orderpriority", 1, 1).alias("plot"),
                       F.when(F.month("o_orderdate") <= 4, "POTR").when(F.month("o_orderdate") <= 8, "PICO").otherwise("LAOC").alias("species"),
                       F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").cast("double").alias("count"), F.lit(2.0).alias("width"))
    c = read(spark, d, "customer")
    sites = c.select(F.concat(F.when(F.col("c_nationkey") < 12, "RE06").otherwise("RB03"), (1 + F.col("c_custkey") % 6).cast("string"),
                              F.lit("x")).alias("plot_name"), F.col("c_acctbal").alias("easting"), (F.col("c_acctbal") * 2).alias("northing"))
    return counts, sites


_INIT_SQL = """w AS (SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN 't1' ELSE 't2' END AS tr, CASE WHEN l_linenumber > 3 THEN 1 ELSE 2 END AS age,
 l_returnflag AS species, sum(CASE WHEN l_quantity > 25 THEN l_quantity END) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
a0 AS (SELECT s.s_name, 270000.0 + s.s_nationkey AS easting, 5390000.0 + s.s_suppkey AS northing, age, species,
 sum(coalesce(n, 0)) / ((coalesce(CASE WHEN s_nationkey > 5 THEN 20.0 + s_nationkey END, 28) + 28) * 2) * 10000 AS dens
 FROM w JOIN supplier s ON s.s_suppkey = w.l_suppkey GROUP BY s.s_name, s.s_nationkey, s.s_suppkey, age, species),
a1 AS (SELECT *, dense_rank() OVER (ORDER BY s_name) AS env_id FROM a0),
a2 AS (SELECT * FROM a1 WHERE dens > 0),
b0 AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'RE06' ELSE 'RB03' END AS fire, substr(o_orderpriority, 1, 1) AS plot,
 CASE WHEN month(o_orderdate) <= 4 THEN 'POTR' WHEN month(o_orderdate) <= 8 THEN 'PICO' ELSE 'LAOC' END AS species,
 quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4),
b1 AS (SELECT *, round_even(n / (50 * 2.0) * 10000, 0) AS cnt FROM b0),
b2 AS (SELECT b1.fire, b1.plot, b1.species, cnt FROM b1 JOIN (SELECT fire, plot, species, max(cnt) AS m FROM b1 GROUP BY 1, 2, 3) x
 ON x.fire = b1.fire AND x.plot = b1.plot AND x.species = b1.species AND b1.cnt = x.m AND x.m > 0 WHERE b1.species <> 'POTR'),
b3 AS (SELECT *, (SELECT max(env_id) FROM a2) + dense_rank() OVER (ORDER BY fire, plot) AS env_id, fire || plot AS pn FROM b2),
st AS (SELECT CASE WHEN c_nationkey < 12 THEN 'RE06' ELSE 'RB03' END || (1 + c_custkey % 6) AS pn, round_even(avg(c_acctbal), 0) AS easting,
 round_even(avg(c_acctbal * 2), 0) AS northing FROM customer GROUP BY 1),
u AS (SELECT 'TH-' || s_name AS plot_name, easting, northing, env_id, species, round_even(dens, 0) AS cnt, age,
 CASE WHEN age = 1 THEN 0.02 ELSE 0.08 END AS height_from, CASE WHEN age = 1 THEN 0.05 ELSE 0.15 END AS height_to FROM a2 UNION ALL
 SELECT 'DM-' || coalesce(b3.pn, st.pn), easting, northing, env_id, species, cnt, CASE WHEN b3.pn IS NULL THEN NULL WHEN fire = 'RE06' THEN 1 ELSE 3 END,
 CASE WHEN b3.pn IS NULL THEN NULL WHEN fire = 'RE06' THEN 0.02 ELSE 0.1 END, CASE WHEN b3.pn IS NULL THEN NULL WHEN fire = 'RE06' THEN 0.05 ELSE 0.3 END
 FROM b3 FULL JOIN st ON b3.pn = st.pn),
f AS (SELECT *, row_number() OVER (ORDER BY env_id NULLS FIRST, species NULLS FIRST, age NULLS FIRST, plot_name, easting, northing, cnt) AS stand_id FROM u)"""


def _init(spark, d):
    a = survey.seedlings_survey_a(_wide_survey(spark, d))
    counts, sites = _belt_survey(spark, d)
    return survey.seedling_tables(a, survey.seedlings_survey_b(counts, sites, a))


@query(f"""WITH {_INIT_SQL} SELECT stand_id, species, CAST(cnt AS DOUBLE) AS count, CAST(height_from AS DOUBLE) AS height_from,
 CAST(height_to AS DOUBLE) AS height_to, age FROM f""")
def seedling_init(spark, d):
    return _init(spark, d)[1]


@query(f"""WITH {_INIT_SQL} SELECT env_id, stand_id, CAST(easting AS DOUBLE) AS easting, CAST(northing AS DOUBLE) AS northing, species, plot_name FROM f""")
def seedling_key(spark, d):
    return _init(spark, d)[0]
