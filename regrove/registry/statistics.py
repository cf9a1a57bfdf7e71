"""Summary, test, correlation, regression and community queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ecology as eco
from ..operators import community as cm, hypothesis as hy, regression as rg, summaries as sm
from .base import R, out, query, read
from .range_sql import NORMAL_GRID, range_cut, range_tail

# --- tails in SQL, by Simpson's rule over the density ------------------------

_SIMPSON = "(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def _normal_p(z: str) -> str:
    return (f"2 * list_sum(list_transform(range(0, 4001), lambda i: {_SIMPSON} * exp(-0.5 * pow(abs({z}) + i * 0.01, 2)))) * 0.01 / 3 / sqrt(2 * pi())")


def _student_p(t: str, v: str) -> str:
    const = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
    dens = f"exp(-({v} + 1) / 2.0 * ln(1 + pow(abs({t}) + i * 0.01, 2) / {v}))"
    return f"2 * list_sum(list_transform(range(0, 4001), lambda i: {_SIMPSON} * {dens})) * 0.01 / 3 * {const}"


def _student_q(v: str) -> str:
    """Upper 2.5 % point for many degrees of freedom (asymptotic expansion)."""
    z = 1.959963984540054
    return (f"({z} + {(z ** 3 + z) / 4} / {v} + {(5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96} / ({v} * {v}))")


# --- summaries ---------------------------------------------------------------

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT variable, " + ", ".join(f"{R(e, 4)} AS {n}" for e, n in (
    ("avg(v)", "value_mean"), ("stddev_samp(v) / sqrt(count(*))", "value_se"), ("min(v)", "value_min"), ("max(v)", "value_max")))
    + ", count(*) AS value_n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS v FROM lineitem" for c in _NUMERIC) + ") GROUP BY 1")
def predictor_summary(spark, d):
    return out(sm.predictor_summary(read(spark, d, "lineitem"), _NUMERIC), digits=4)


@query(f"""SELECT l_returnflag, {R('median(l_extendedprice)', 4)} AS l_extendedprice_med, {R('stddev_samp(l_extendedprice) / sqrt(count(*))', 4)} AS l_extendedprice_se,
 {R('median(l_tax)', 4)} AS l_tax_med, {R('stddev_samp(l_tax) / sqrt(count(*))')} AS l_tax_se FROM lineitem GROUP BY 1""")
def median_se(spark, d):
    return out(sm.median_and_se(read(spark, d, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_tax"]),
               l_extendedprice_med=4, l_extendedprice_se=4, l_tax_med=4)


@query(f"""WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 19 AS w FROM lineitem GROUP BY 1)
SELECT l_returnflag, l_linestatus, CAST(floor((l_extendedprice - lo) / w + 0.5) AS INTEGER) AS bin, count(*) AS n,
 {R('any_value(lo + floor((l_extendedprice - lo) / w + 0.5) * w)', 4)} AS center FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1, 2, 3""")
def histogram(spark, d):
    return out(sm.histogram(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 20, ["l_linestatus"]), digits=4)


@query(f"""SELECT event_type, CAST(floor(log10(value) / 0.2 + 0.5) AS INTEGER) AS bin, count(*) AS n,
 {R('floor(log10(value) / 0.2 + 0.5) * 0.2')} AS center FROM events WHERE value > 0 GROUP BY 1, 2, 4""")
def log_histogram(spark, d):
    return out(sm.log_histogram(read(spark, d, "events"), ["event_type"], "value"))


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
x AS (SELECT *, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q USING (event_type))
SELECT event_type, {R('any_value(q1)')} AS q1, {R('any_value(med)')} AS med, {R('any_value(q3)')} AS q3, {R('min(value) FILTER (ok)')} AS low_whisker,
 {R('max(value) FILTER (ok)')} AS high_whisker, count(*) FILTER (NOT ok) AS n_out FROM x GROUP BY 1""")
def boxplot_stats(spark, d):
    return out(sm.box_stats(read(spark, d, "events"), ["event_type"], "value"))


@query(f"""WITH m AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS b, avg(p_retailprice) AS c, stddev_samp(p_retailprice) AS e FROM part)
SELECT p_partkey, {R('(p_size - a) / b')} AS p_size, {R('(p_retailprice - c) / e')} AS p_retailprice FROM part, m""")
def zscore(spark, d):
    return out(sm.z_scores(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


# --- tests -------------------------------------------------------------------

_AOV = """m AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_linestatus, sum(n * m) / sum(n) AS gm FROM m GROUP BY 1),
a AS (SELECT l_linestatus, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, sum(n * (m - gm) * (m - gm)) AS ssb, sum(ss) AS ssw
 FROM m JOIN g USING (l_linestatus) GROUP BY 1), b AS (SELECT *, (ssb / df_between) / (ssw / df_within) AS f FROM a)"""


@query(f"""WITH {_AOV} SELECT l_linestatus, df_between, df_within, {R('ssb / 1e6', 4)} AS ss_between, {R('ssw / 1e6', 2)} AS ss_within, {R('f')} AS f,
 {R('pow(1 + 2 * f / df_within, -df_within / 2.0)')} AS p, {R('ssb / (ssb + ssw)', 8)} AS r_squared FROM b""")
def anova_oneway(spark, d):
    a = hy.anova(read(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_extendedprice")
    a = a.withColumns({"ss_between": F.col("ss_between") / 1e6, "ss_within": F.col("ss_within") / 1e6})
    return out(a, "l_linestatus", "df_between", "df_within", "ss_between", "ss_within", "f", "p", "r_squared",
               ss_between=4, ss_within=2, r_squared=8)


@query(f"""WITH m AS (SELECT l_returnflag, l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
e AS (SELECT l_returnflag, sum(ss) / (sum(n) - 2) AS mse, sum(n) - 2 AS v FROM m GROUP BY 1),
t AS (SELECT a.l_returnflag, a.g AS group_lo, b.g AS group_hi, b.m - a.m AS estimate, sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS se, CAST(v AS DOUBLE) AS v
 FROM m a JOIN m b ON a.l_returnflag = b.l_returnflag AND a.g < b.g JOIN e ON e.l_returnflag = a.l_returnflag)
SELECT l_returnflag, group_lo, group_hi, {R('estimate', 4)} AS estimate, {R('se', 4)} AS se, {R('abs(estimate) / se')} AS q,
 {R('estimate - sqrt(2) * se * ' + _student_q('v'), 2)} AS conf_low, {R('estimate + sqrt(2) * se * ' + _student_q('v'), 2)} AS conf_high,
 {R(_student_p('(estimate / se / sqrt(2))', 'v'), 5)} AS p_adj FROM t""")
def tukey_pairs(spark, d):
    t = hy.tukey(read(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_extendedprice")
    return out(t, digits=4, q=6, p_adj=5, conf_low=2, conf_high=2)


def _pairs_sql(table: str, key: str, group: str, value: str) -> str:
    """Level moments ``m``, error ``e`` and pairs ``t`` of levels."""
    return f"""m AS (SELECT {key} AS key, {group} AS g, count(*) AS n, avg({value}) AS m, var_pop({value}) * count(*) AS ss FROM {table} GROUP BY 1, 2),
e AS (SELECT key, count(*) AS k, sum(ss) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS DOUBLE) AS v FROM m GROUP BY 1),
t0 AS (SELECT a.key, a.g AS lo, b.g AS hi, b.m - a.m AS estimate, sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS se, k, v
 FROM m a JOIN m b ON a.key = b.key AND a.g < b.g JOIN e ON e.key = a.key),
t AS (SELECT *, abs(estimate) / se AS q FROM t0), {NORMAL_GRID}, {range_tail('t', 'q', 'tail', 'key, lo, hi')}"""


@query(f"""WITH {_pairs_sql('lineitem', 'l_linestatus', 'l_returnflag', 'l_extendedprice')}, {range_cut('e', 0.05, 3.31449, 'cut', 'key')}
SELECT t.key AS l_linestatus, t.lo AS group_lo, t.hi AS group_hi, {R('estimate', 4)} AS estimate, {R('se', 4)} AS se, {R('t.q', 4)} AS q,
 {R('estimate - cut.q * se', 2)} AS conf_low, {R('estimate + cut.q * se', 2)} AS conf_high, {R('p', 4)} AS p_adj
FROM t JOIN tail USING (key, lo, hi) JOIN cut ON cut.key = t.key""")
def tukey_three_levels(spark, d):
    return out(hy.tukey(read(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_extendedprice"), digits=4, conf_low=2, conf_high=2)


# Columns of the display are the largest sets of levels without a differing pair.
@query(f"""WITH {_pairs_sql('lineitem', 'l_returnflag', 'l_linenumber', 'l_extendedprice + 800 * l_linenumber')},
pos AS (SELECT key, g, row_number() OVER (PARTITION BY key ORDER BY m, g) - 1 AS i FROM m),
bad AS (SELECT tail.key, (1 << a.i) | (1 << b.i) AS pair FROM tail JOIN pos a ON a.key = tail.key AND a.g = lo JOIN pos b ON b.key = tail.key AND b.g = hi WHERE p < 0.05),
sets AS (SELECT e.key, c FROM e, (SELECT unnest(range(1, 128)) AS c) WHERE c < (1 << e.k)
 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = e.key AND c & pair = pair)),
top AS (SELECT * FROM sets s WHERE NOT EXISTS (SELECT 1 FROM sets o WHERE o.key = s.key AND o.c <> s.c AND o.c & s.c = s.c)),
named AS (SELECT *, chr(CAST(96 + row_number() OVER (PARTITION BY key ORDER BY list_transform(list_filter(range(0, 7), lambda i: (c >> i) & 1 = 1), lambda i: chr(CAST(97 + i AS INTEGER)))) AS INTEGER)) AS letter FROM top)
SELECT pos.key AS l_returnflag, pos.g AS l_linenumber, string_agg(letter, '' ORDER BY letter) AS letters
FROM pos JOIN named ON named.key = pos.key AND (c >> i) & 1 = 1 GROUP BY 1, 2""")
def letters(spark, d):
    li = read(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") + 800 * F.col("l_linenumber"))
    return hy.letters(li, ["l_returnflag"], "l_linenumber", "price")


@query(f"""WITH x AS (SELECT o_orderpriority AS k, o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F'),
m AS (SELECT k, median(v) AS med FROM x GROUP BY 1), y AS (SELECT k, g, count(*) AS n, count(*) FILTER (v > med) AS t FROM x JOIN m USING (k) GROUP BY 1, 2),
r AS (SELECT k, min_by(n, g) AS n1, min_by(t, g) AS above1, sum(n) AS n, sum(t) AS a FROM y GROUP BY 1),
z AS (SELECT *, (above1 - n1 * a / n) / sqrt(n1 * (n - n1) * (a / n) * (1 - a / n) / (n - 1)) AS z FROM r)
SELECT k AS o_orderpriority, {R('med', 4)} AS median, n1, CAST(n AS BIGINT) AS n, above1, {R('z')} AS z, {R(_normal_p('z'))} AS p FROM z JOIN m USING (k)""")
def median_test(spark, d):
    o = read(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return out(hy.median_test(o, ["o_orderpriority"], "o_orderstatus", "o_totalprice"), median=4)


def _ks_sql(key: str) -> str:
    return f"""x AS (SELECT {key} AS k, o_totalprice AS v, count(*) FILTER (o_orderstatus = 'O') AS a, count(*) FILTER (o_orderstatus = 'P') AS b
 FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
c AS (SELECT k, abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS g, sum(a) OVER t AS n1, sum(b) OVER t AS n2 FROM x
 WINDOW w AS (PARTITION BY k ORDER BY v), t AS (PARTITION BY k)), s AS (SELECT k, max(g) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM c GROUP BY 1)"""


@query(f"""WITH {_ks_sql('o_orderpriority')} SELECT k AS o_orderpriority, {R('d')} AS d, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM s""")
def ks_by_group(spark, d):
    k = hy.ks_two_sample(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "O", "P")
    return out(k, "o_orderpriority", "d", "n1", "n2")


@query(f"""WITH {_ks_sql("'all'")} SELECT {R('d')} AS d, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
 {R("2 * list_sum(list_transform(range(1, 200), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * d * d * n1 * n2 / (n1 + n2))))")} AS p FROM s""")
def ks_two_sample(spark, d):
    return out(hy.ks_two_sample(read(spark, d, "orders"), [], "o_orderstatus", "o_totalprice", "O", "P"))


def _corr_sql(x: str, y: str, src: str, key: str, name: str) -> str:
    return f"""c AS (SELECT {key}, corr({x}, {y}) AS r, count(*) AS n FROM {src} GROUP BY 1),
s AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, CAST(n - 2 AS DOUBLE) AS v FROM c)
SELECT {key}, {R('r')} AS {name}, n, {R('t')} AS t, {R(_student_p('t', 'v'))} AS p FROM s"""


@query("WITH " + _corr_sql("l_quantity", "l_extendedprice / l_quantity", "lineitem", "l_returnflag", "r"))
def pearson_test(spark, d):
    li = read(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return out(hy.pearson(li, ["l_returnflag"], "l_quantity", "unit"))


@query("WITH x AS (SELECT o_orderstatus, rank() OVER a + (count(*) OVER b - 1) / 2.0 AS rx, rank() OVER c + (count(*) OVER e - 1) / 2.0 AS ry FROM orders "
       "WINDOW a AS (PARTITION BY o_orderstatus ORDER BY o_totalprice), b AS (PARTITION BY o_orderstatus, o_totalprice), "
       "c AS (PARTITION BY o_orderstatus ORDER BY o_custkey), e AS (PARTITION BY o_orderstatus, o_custkey)), " + _corr_sql("rx", "ry", "x", "o_orderstatus", "rho"))
def spearman_test(spark, d):
    return out(hy.spearman(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_custkey"))


@query()
def spearman_small_sample(spark, d):
    """Balances against keys of the suppliers of each nation, with the small-sample law of the rank distance."""
    return out(hy.spearman(read(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", small_sample=True))


_VARS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax", "unit"]
_RANKS = "x AS (SELECT *, l_extendedprice / l_quantity AS unit FROM lineitem), r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in _VARS) + " FROM x), m AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS rho FROM r" for i, a in enumerate(_VARS) for b in _VARS[i + 1:]) + ")"


def _matrix(spark, d):
    li = read(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return hy.spearman_matrix(li, _VARS)


@query(f"WITH {_RANKS} SELECT var1, var2, {R('rho')} AS rho, abs(rho) <= 0.5 AS allowed FROM m")
def spearman_matrix(spark, d):
    m = _matrix(spark, d)
    return out(m.join(hy.independence_mask(m), ["var1", "var2"]))


@query(f"WITH {_RANKS} SELECT var1, var2, {R('rho')} AS rho FROM m WHERE abs(rho) >= 0.5")
def collinear_pairs(spark, d):
    return out(hy.collinear_pairs(_matrix(spark, d)))


@query()
def bootstrap_ci(spark, d):
    return out(hy.bootstrap_mean(read(spark, d, "events"), ["event_type"], "value", ["event_id"], reps=1000,
                                 min_partitions=spark.sparkContext.defaultParallelism))


# --- linear models -----------------------------------------------------------

_LOGS = "g AS (SELECT l_returnflag, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem)"
_FIT = """f AS (SELECT {k}, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, avg(x) AS mx, min(x) AS lo, max(x) AS hi,
 regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM g GROUP BY {k})"""


@query(f"""WITH {_LOGS}, {_FIT.format(k='l_returnflag')}, t AS (SELECT l_returnflag, n, '(Intercept)' AS term, a AS estimate, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se FROM f
 UNION ALL SELECT l_returnflag, n, 'x', b, sqrt(rss / (n - 2) / sxx) FROM f)
SELECT l_returnflag, term, {R('estimate')} AS estimate, {R('se')} AS se, {R('estimate / se', 3)} AS t, {R(_student_p('(estimate / se)', 'CAST(n - 2 AS DOUBLE)'))} AS p, n FROM t""")
def lm_by_group(spark, d):
    g = read(spark, d, "lineitem").select("l_returnflag", F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))
    return out(rg.simple_lm(g, ["l_returnflag"], "x", "y"), t=3)


@query(f"""WITH {_LOGS}, {_FIT.format(k='l_returnflag')}, k AS (SELECT unnest(range(80)) AS step),
b AS (SELECT *, lo + (hi - lo) * step / 79 AS xx, sqrt(rss / (n - 2) * (1.0 / n + (lo + (hi - lo) * step / 79 - mx) * (lo + (hi - lo) * step / 79 - mx) / sxx)) AS se FROM f, k)
SELECT l_returnflag, CAST(step AS INTEGER) AS step, {R('xx')} AS x, {R('a + b * xx')} AS fit, {R('se')} AS se,
 {R('a + b * xx - se * ' + _student_q('CAST(n - 2 AS DOUBLE)'))} AS lower, {R('a + b * xx + se * ' + _student_q('CAST(n - 2 AS DOUBLE)'))} AS upper FROM b""")
def lm_band(spark, d):
    g = read(spark, d, "lineitem").select("l_returnflag", F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))
    return out(rg.lm_band(g, ["l_returnflag"], "x", "y"))


_TWO = "g AS (SELECT l_linestatus, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), " + _FIT.format(k="l_linestatus")


@query(f"""WITH {_TWO}, u AS (SELECT *, sum(rss) OVER () / (sum(n) OVER () - 4) AS s2, sum(rss) OVER () AS tot, sum(n) OVER () AS nn FROM f),
v AS (SELECT *, s2 * (1.0 / n + mx * mx / sxx) AS va, s2 / sxx AS vb FROM u), a AS (SELECT * FROM v WHERE l_linestatus = 'F'), b AS (SELECT * FROM v WHERE l_linestatus = 'O'),
t AS (SELECT '(Intercept)' AS term, a.a AS e, a.va AS q, tot, nn FROM a UNION ALL SELECT 'l_quantity', a.b, a.vb, tot, nn FROM a
 UNION ALL SELECT 'l_linestatusO', b.a - a.a, a.va + b.va, a.tot, a.nn FROM a, b UNION ALL SELECT 'l_quantity:l_linestatusO', b.b - a.b, a.vb + b.vb, a.tot, a.nn FROM a, b)
SELECT term, {R('e')} AS estimate, {R('sqrt(q)')} AS se, {R('e / sqrt(q)', 4)} AS t, {R(_student_p('(e / sqrt(q))', 'CAST(nn - 4 AS DOUBLE)'))} AS p, CAST(nn AS BIGINT) AS n, {R('tot', 2)} AS rss FROM t""")
def lm_interaction(spark, d):
    li = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    df, main, cross = rg.interaction_terms(li, "l_quantity", "l_linestatus", ["F", "O"])
    return out(rg.linear_model(df, "y", main + cross), "term", "estimate", "se", "t", "p", "n", "rss", t=4, rss=2)


@query(f"""WITH {_TWO}, w AS (SELECT count(*) - 2 AS d0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS r0 FROM g), z AS (SELECT sum(n) - 4 AS d1, sum(rss) AS r1 FROM f),
s AS (SELECT *, ((r0 - r1) / 2) / (r1 / d1) AS ff FROM w, z)
SELECT d0 AS df_reduced, {R('r0', 2)} AS rss_reduced, CAST(d1 AS BIGINT) AS df_full, {R('r1', 2)} AS rss_full, {R('ff', 5)} AS f, {R('pow(1 + 2 * ff / d1, -d1 / 2.0)', 5)} AS p FROM s""")
def nested_f(spark, d):
    li = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    df, main, cross = rg.interaction_terms(li, "l_quantity", "l_linestatus", ["F", "O"])
    return out(rg.nested_f(df, "y", ["l_quantity"], main[1:] + cross), f=5, p=5, rss_reduced=2, rss_full=2)


# --- communities -------------------------------------------------------------

_EVENTS = ["click", "error", "purchase", "signup", "view"]


def _user_days(spark, d):
    return read(spark, d, "events").withColumns({"day": F.dayofmonth("ts"), "time": F.when(F.dayofmonth("ts") < 16, "pre").otherwise("post")})


@query("SELECT user_id, " + ", ".join(R(f"coalesce(sum(value) FILTER (event_type = '{e}'), 0)", 4) + f" AS {e}" for e in _EVENTS) + " FROM events GROUP BY 1")
def species_matrix(spark, d):
    return out(cm.species_matrix(read(spark, d, "events"), ["user_id"], "event_type", _EVENTS, "value"), digits=4)


@query(f"""WITH x AS (SELECT user_id, event_type, round_even(coalesce(sum(value) FILTER (day(ts) = 5), 0), 0) AS a,
 round_even(coalesce(sum(value) FILTER (day(ts) = 25), 0), 0) AS b FROM events WHERE day(ts) IN (5, 25) GROUP BY 1, 2),
s AS (SELECT user_id, sum(abs(a - b)) AS d, sum(a) AS ta, sum(b) AS tb FROM x GROUP BY 1)
SELECT user_id, {R('CASE WHEN ta > 0 AND tb > 0 THEN d / (ta + tb) END')} AS bray FROM s WHERE ta > 0 OR tb > 0""")
def bray_prepost(spark, d):
    return out(cm.change_dissimilarity(_user_days(spark, d), ["user_id"], "day", 5, 25, "event_type", _EVENTS, "value"))


_SITES = """s AS (SELECT row_number() OVER () AS id, * FROM (SELECT user_id, day(ts) AS d, CASE WHEN day(ts) < 16 THEN 'pre' ELSE 'post' END AS g,
 bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END) AS m FROM events GROUP BY 1, 2, 3)),
p AS (SELECT least(a.m, b.m) AS ma, greatest(a.m, b.m) AS mb, a.g = b.g AS same,
 1.0 - 2.0 * bit_count(a.m & b.m) / (bit_count(a.m) + bit_count(b.m)) AS d FROM s a JOIN s b ON a.id < b.id)"""


def _sites(spark, d):
    return cm.site_patterns(_user_days(spark, d), ["user_id", "day", "time"], "event_type", _EVENTS)


@query(f"""WITH {_SITES}, c AS (SELECT m, count(*) AS n FROM s GROUP BY 1), k AS (SELECT ma, mb, count(*) AS n_pairs, any_value(d) AS d FROM p GROUP BY 1, 2)
SELECT CAST(a.m AS INTEGER) AS pattern_a, CAST(b.m AS INTEGER) AS pattern_b, a.n AS n_a, b.n AS n_b, coalesce(n_pairs, 0) AS n_pairs,
 {R('1.0 - 2.0 * bit_count(a.m & b.m) / (bit_count(a.m) + bit_count(b.m))')} AS bray FROM c a JOIN c b ON a.m <= b.m LEFT JOIN k ON k.ma = a.m AND k.mb = b.m""")
def bray_pairs(spark, d):
    return out(cm.pattern_dissimilarity(_sites(spark, d), len(_EVENTS)))


@query(f"""WITH {_SITES}, q AS (SELECT d, count(*) AS n, count(*) FILTER (same) AS w FROM (SELECT round(d, 9) AS d, same FROM p) GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY d) - n + (n + 1) / 2.0 AS rk, sum(n) OVER () AS m FROM q)
SELECT {R('(sum(rk * (n - w)) / sum(n - w) - sum(rk * w) / sum(w)) / (any_value(m) / 2.0)', 8)} AS r, (SELECT count(*) FROM s) AS n_sites,
 (SELECT count(DISTINCT g) FROM s) AS n_groups FROM r""")
def anosim_r(spark, d):
    return out(cm.anosim(_sites(spark, d), "time", permutations=1), "r", "n_sites", "n_groups", digits=8).withColumn("n_groups", F.col("n_groups").cast("bigint"))


@query()
def anosim_permutations(spark, d):
    return out(cm.anosim(_sites(spark, d), "time", permutations=999), "r", "n_sites", "permutations", "p")


@query()
def nmds(spark, d):
    return out(cm.nmds(_sites(spark, d), starts=50), digits=4)


@query()
def nmds_group_centroids(spark, d):
    sites = _sites(spark, d)
    scores = cm.site_scores(sites, cm.nmds(sites, starts=20))
    c = cm.group_centroids(scores, ["time"])
    lo, hi = eco.normal_interval("nmds1_mean", "nmds1_se")
    return out(c.withColumns({"nmds1_lower": lo, "nmds1_upper": hi}), digits=4)


@query()
def nmds_species_scores(spark, d):
    return out(cm.species_scores(cm.nmds(_sites(spark, d), starts=20), _EVENTS), digits=4)
