"""Reshape, cleaning, join, grouping and numbering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ecology as eco, missing as ms
from ..operators import grouping as gp, joins as jn, reshape as rs
from .base import R, out, query, read

_FLAGS = ["A", "N", "R"]
_LINES = [1, 2, 3, 4, 5, 6, 7]


def _wide(li):
    tagged = li.withColumn("slot", F.concat_ws("_", "l_linenumber", "l_returnflag"))
    slots = [f"{n}_{f}" for n in _LINES for f in _FLAGS]
    return rs.cast_wide(tagged, ["l_orderkey"], "slot", slots, ["l_quantity"], agg=F.sum,
                        template="qty_{key}"), slots


_SLOT_SUMS = ", ".join(
    f"sum(CASE WHEN l_linenumber = {n} AND l_returnflag = '{f}' THEN l_quantity END) AS qty_{n}_{f}"
    for n in _LINES for f in _FLAGS)


@query(f"""
WITH w AS (SELECT l_orderkey, {_SLOT_SUMS} FROM lineitem GROUP BY l_orderkey),
u AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (qty FOR name IN ({", ".join(f"qty_{n}_{f}" for n in _LINES for f in _FLAGS)})))
SELECT l_orderkey, split_part(name, '_', 2) AS line, split_part(name, '_', 3) AS flag, qty FROM u""")
def melt_name_parts(spark, d):
    wide, slots = _wide(read(spark, d, "lineitem"))
    cols = rs.matching(wide, prefixes=["QTY"], exclude_contains=["note"])
    return rs.melt_parts(wide, ["l_orderkey"], cols, [None, "line", "flag"], values_to="qty")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0.0) AS qty_A,
 coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0.0) AS qty_N,
 coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0.0) AS qty_R,
 coalesce(max(l_tax) FILTER (l_returnflag = 'A'), 0.0) AS tax_A,
 coalesce(max(l_tax) FILTER (l_returnflag = 'N'), 0.0) AS tax_N,
 coalesce(max(l_tax) FILTER (l_returnflag = 'R'), 0.0) AS tax_R
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def cast_wide_fill(spark, d):
    li = read(spark, d, "lineitem")
    long = li.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_tax").alias("tax"))
    return rs.cast_wide(long, ["l_orderkey", "l_linenumber"], "l_returnflag", _FLAGS, ["qty", "tax"], fill=0.0)


@query("""
WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS num, max(l_quantity) AS qty, max(l_tax) AS tax
 FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT DISTINCT l_orderkey FROM lineitem), n AS (SELECT unnest(['1','2','3','4','5','6','7']) AS num)
SELECT k.l_orderkey, n.num, r.qty, CAST(r.tax AS VARCHAR) AS tax FROM k CROSS JOIN n
LEFT JOIN r ON r.l_orderkey = k.l_orderkey AND r.num = n.num WHERE r.qty IS NOT NULL""")
def melt_wide_records(spark, d):
    li = read(spark, d, "lineitem")
    wide = li.groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == n, F.col(f"l_{src}"))).alias(f"item_{n}_{att}")
          for n in _LINES for src, att in (("quantity", "qty"), ("tax", "tax"))])
    rec = rs.melt_records(wide, ["l_orderkey"], rs.matching(wide, prefixes=["item"]), [None, "num", "att"], "att",
                          types={"qty": "double"})
    return rec.filter(F.col("qty").isNotNull())


@query("""
SELECT p_partkey, name, value FROM (
 SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part UNION ALL
 SELECT p_partkey, 'p_type', p_type FROM part UNION ALL
 SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part)""")
def melt_mixed_types(spark, d):
    p = read(spark, d, "part")
    return rs.melt(p, ["p_partkey"], rs.column_range(p, "p_brand", "p_size"), value_type="string")


@query("""
SELECT p_partkey, split_part(b, '#', 1) AS maker, split_part(b, '#', 2) AS code, split_part(b, '#', 1) || '_' || p_type AS united
FROM (SELECT p_partkey, p_brand AS b, p_type FROM part)""")
def split_unite_columns(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    s = rs.split_column(p, "p_brand", ["maker", "code"], sep="#")
    return rs.unite_columns(s.withColumn("m2", F.col("maker")), "united", ["m2", "p_type"])


@query("""
SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS A,
 max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS N, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS R
FROM lineitem GROUP BY l_suppkey""")
def presence_absence(spark, d):
    wide = rs.cast_wide(read(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", _FLAGS, ["l_quantity"], fill=0.0, agg=F.sum)
    return rs.presence(rs.drop_empty_rows(wide, _FLAGS), _FLAGS)


_LEFT = """a AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, o_orderstatus AS s,
 count(*) AS n_left, sum(o_totalprice) AS amt FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)"""
_RIGHT = """b AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, o_orderstatus AS s,
 count(*) AS n_right FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)"""


def _keyed_orders(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_custkey")).alias("k"),
                    F.col("o_orderstatus").alias("s"), "o_totalprice")


@query(f"""
WITH {_LEFT}, {_RIGHT}
SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, n_left, {R('amt', 2)} AS amt, n_right
FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.s IS NOT DISTINCT FROM b.s""")
def null_safe_full_join(spark, d):
    o = _keyed_orders(spark, d)
    a = o.filter("s <> 'F'").groupBy("k", "s").agg(F.count("*").alias("n_left"), F.sum("o_totalprice").alias("amt"))
    b = o.filter("s <> 'P'").groupBy("k", "s").agg(F.count("*").alias("n_right"))
    return out(jn.natural_full(a, b), digits=2)


@query("""
WITH a AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders),
b AS (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS k, c_mktsegment FROM customer)
SELECT coalesce(a.k, b.k) AS k, a.o_orderkey, b.c_mktsegment FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def hot_key_full_join(spark, d):
    # A fifth of the orders share the null key; the split form spreads them.
    a = read(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_custkey")).alias("k"), "o_orderkey")
    b = read(spark, d, "customer").select(
        F.when(F.col("c_custkey") == 0, None).otherwise(F.col("c_custkey")).alias("k"), "c_mktsegment")
    return jn.natural_full(a, b, ["k"])


@query("""
SELECT c.c_custkey AS k, c.c_nationkey, n.n_name FROM
 (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer) c
LEFT JOIN (SELECT CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey END AS nk, n_name FROM nation WHERE n_nationkey < 20) n
 ON c.c_nationkey IS NOT DISTINCT FROM n.nk""")
def natural_left_join(spark, d):
    zero = lambda c: F.when(F.col(c) == 0, None).otherwise(F.col(c))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), zero("c_nationkey").alias("c_nationkey"))
    n = read(spark, d, "nation").filter("n_nationkey < 20").select(zero("n_nationkey").alias("c_nationkey"), "n_name")
    return jn.natural_left(c, n)


@query("""
WITH k AS (SELECT DISTINCT user_id FROM events), t AS (SELECT unnest(['click','error','purchase','signup','view','refund']) AS event_type),
a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT k.user_id, t.event_type, coalesce(a.n, 0) AS n FROM k CROSS JOIN t
LEFT JOIN a ON a.user_id = k.user_id AND a.event_type = t.event_type""")
def fill_grid(spark, d):
    a = gp.tally(read(spark, d, "events"), ["user_id", "event_type"])
    return jn.complete_grid(a, "user_id", {"event_type": ["click", "error", "purchase", "signup", "view", "refund"]}, {"n": 0})


@query(f"""
WITH x AS (SELECT l_suppkey, CASE WHEN NOT (l_quantity = 50 AND l_tax = 0.08 AND l_linenumber = 1) THEN l_tax END AS t FROM lineitem)
SELECT l_suppkey, {R('CASE WHEN count(t) = count(*) THEN avg(t) END')} AS mean_tax,
 {R('CASE WHEN count(t) = count(*) THEN sum(t) END')} AS sum_tax, {R('coalesce(sum(t), 0)')} AS skip_sum, count(*) AS n,
 {R('stddev_samp(t) / sqrt(count(*))')} AS se_tax
FROM x GROUP BY l_suppkey""")
def strict_aggregates(spark, d):
    x = read(spark, d, "lineitem").withColumn(
        "t", F.expr("CASE WHEN NOT (l_quantity = 50 AND l_tax = 0.08 AND l_linenumber = 1) THEN l_tax END"))
    return out(x.groupBy("l_suppkey").agg(
        ms.strict_mean("t").alias("mean_tax"), ms.strict_sum("t").alias("sum_tax"), ms.skip_sum("t").alias("skip_sum"),
        F.count("*").alias("n"), ms.std_error("t").alias("se_tax")))


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_per_key(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return gp.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'STANDARD' ELSE p_type END AS recoded,
 CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'LOW' WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'HIGH' ELSE p_type END AS grouped,
 CASE p_type WHEN 'SMALL' THEN 'Small (s)' WHEN 'MEDIUM' THEN 'Medium (m)' WHEN 'LARGE' THEN 'Large (l)' END AS label,
 CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS ord,
 CASE WHEN p_size < 10 THEN 'tiny' WHEN p_size < 30 THEN 'mid' END AS branch
FROM part""")
def recode_label(spark, d):
    levels = ["SMALL", "MEDIUM", "LARGE"]
    return read(spark, d, "part").select(
        "p_partkey", ms.recode("p_type", "PROMO", "STANDARD").alias("recoded"),
        ms.collapse("p_type", {"LOW": ["SMALL", "MEDIUM"], "HIGH": ["LARGE", "ECONOMY"]}).alias("grouped"),
        ms.label("p_type", levels, ["Small (s)", "Medium (m)", "Large (l)"]).alias("label"),
        ms.level_order("p_type", levels).alias("ord"),
        ms.branch((F.col("p_size") < 10, "tiny"), (F.col("p_size") < 30, "mid")).alias("branch"))


@query("""
WITH x AS (SELECT c_custkey, nullif(c_nationkey, 3) AS g, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS b, c_acctbal FROM customer)
SELECT c_custkey, CASE WHEN b > 8000 THEN 8000.0 ELSE b END AS capped,
 CASE WHEN c_acctbal < 1000 THEN 1000.0 WHEN c_acctbal > 9000 THEN 9000.0 ELSE c_acctbal END AS clamped,
 coalesce(b, 0.0) AS filled, CASE WHEN b IS NULL THEN NULL WHEN b > 5000 THEN 'rich' ELSE 'poor' END AS tier,
 coalesce(g IN (1, 2, 3), false) AS listed, NOT coalesce(g IN (1, 2, 3), false) AS unlisted FROM x""")
def clamp_cap_default(spark, d):
    x = read(spark, d, "customer").withColumns({
        "g": F.nullif("c_nationkey", F.lit(3)), "b": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    return x.select("c_custkey", ms.cap("b", 8000.0).alias("capped"), ms.clamp("c_acctbal", 1000.0, 9000.0).alias("clamped"),
                    ms.default("b", 0.0).alias("filled"), ms.if_else(F.col("b") > 5000, "rich", "poor").alias("tier"),
                    ms.member("g", [1, 2, 3]).alias("listed"), ms.not_member("g", [1, 2, 3]).alias("unlisted"))


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, nullif(l_discount, 0.0) * 100 AS b, l_tax * 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('(a + b + c) / 3')} AS row_mean,
 {R('CASE WHEN b IS NULL THEN NULL ELSE least(a, b, c) END')} AS row_min, {R('a + b + c')} AS row_sum FROM x
""")
def rowwise_measures(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"),
                                          (F.nullif("l_discount", F.lit(0.0)) * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return out(x.select("l_orderkey", "l_linenumber", ms.row_mean("a", "b", "c").alias("row_mean"),
                        ms.row_min("a", "b", "c").alias("row_min"), ms.row_sum("a", "b", "c").alias("row_sum")))


@query(f"""
SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), 'NA') || '-' || p_type AS plot_id, substr(p_name, 1, length(p_name) - 1) AS cut,
 upper(p_name) AS big, regexp_replace(p_brand, 'Brand#', '') AS code, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS num,
 TRY_CAST(p_brand AS DOUBLE) AS bad, round_even(p_size / 2.0, 0) AS half_even,
 {R('log10(p_size + 1)')} AS log_plus, {R('ln(p_retailprice)')} AS ln_price, round_even(p_retailprice / 100, 0) AS elev_class
FROM part""")
def scalar_functions(spark, d):
    p = read(spark, d, "part")
    df = p.select("p_partkey", ms.paste(F.nullif("p_brand", F.lit("Brand#1")), "p_type", sep="-").alias("plot_id"),
                  F.expr("substr(p_name, 1, length(p_name) - 1)").alias("cut"), F.upper("p_name").alias("big"),
                  F.regexp_replace("p_brand", "Brand#", "").alias("code"),
                  ms.to_integer(F.split("p_brand", "#")[1]).alias("num"), ms.to_number("p_brand").alias("bad"),
                  ms.round_even(F.col("p_size") / 2.0).alias("half_even"), F.log10(F.col("p_size") + 1).alias("log_plus"),
                  F.log("p_retailprice").alias("ln_price"), eco.elevation_class("p_retailprice").alias("elev_class"))
    return out(df)


@query("""
SELECT l.l_suppkey, l.l_partkey, l.l_orderkey, l.l_quantity FROM lineitem l
JOIN (SELECT l_suppkey, l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) g
 ON g.l_suppkey = l.l_suppkey AND g.l_returnflag = l.l_returnflag AND l.l_quantity = g.m AND g.m > 0""")
def group_max_rows(spark, d):
    top = gp.group_maximum(read(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity")
    return top.select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")


@query("""
SELECT o_orderkey, (SELECT max(n_nationkey) FROM nation) + dense_rank() OVER (ORDER BY o_custkey, o_orderstatus) AS stand_id FROM orders""")
def dense_group_id(spark, d):
    base = read(spark, d, "nation").agg(F.max("n_nationkey"))
    df = gp.group_index(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "stand_id", base)
    return df.select("o_orderkey", "stand_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS plot_num FROM orders")
def row_numbers(spark, d):
    return gp.number_rows(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"],
                          "plot_num").select("o_orderkey", "plot_num")


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def latest_period(spark, d):
    o = read(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    return gp.at_latest(o, "yr").select("o_orderkey", "yr", "o_totalprice")


@query("""
SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, count(*) AS n FROM events GROUP BY 1, 2""")
def tally_groups(spark, d):
    e = read(spark, d, "events").withColumn("half", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return gp.tally(e, ["event_type", "half"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_values(spark, d):
    return read(spark, d, "events").select("user_id", "event_type").distinct()


@query("""
SELECT 'customer' AS source, c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL
SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_tagged(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return jn.bind_rows({"customer": c, "supplier": s}, "source").select("source", "k", "bal", "seg")


@query(f"""
SELECT l_returnflag, {R('avg(l_quantity)')} AS l_quantity_mean, {R('stddev_samp(l_quantity)/sqrt(count(*))')} AS l_quantity_se,
 {R('max(l_quantity)')} AS l_quantity_max, {R('avg(l_tax)')} AS l_tax_mean, {R('stddev_samp(l_tax)/sqrt(count(*))')} AS l_tax_se,
 {R('max(l_tax)')} AS l_tax_max FROM lineitem GROUP BY 1""")
def summarise_across(spark, d):
    return out(rs.summarise_across(read(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"],
                                   {"mean": F.avg, "se": ms.std_error, "max": F.max}))


@query(f"""
SELECT c_mktsegment, {R('avg(c_custkey)')} AS c_custkey, {R('avg(c_nationkey)')} AS c_nationkey, {R('avg(c_acctbal)')} AS c_acctbal
FROM customer GROUP BY 1""")
def numeric_means(spark, d):
    return out(rs.numeric_means(read(spark, d, "customer"), ["c_mktsegment"]))


@query(f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, {R('l_extendedprice - m', 4)} AS dev, n FROM lineitem JOIN
 (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (l_returnflag, l_linestatus)""")
def group_stats_beside_rows(spark, d):
    g = gp.with_group(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], m=F.avg("l_extendedprice"), n=F.count(F.lit(1)))
    return out(g.withColumn("dev", F.col("l_extendedprice") - F.col("m")), "l_orderkey", "l_linenumber", "l_extendedprice",
               "dev", "n", digits=4)


@query(f"""
WITH m AS (SELECT p_brand, median(p_retailprice) AS k FROM part GROUP BY 1)
SELECT p_brand, {R('k', 4)} AS median_key, row_number() OVER (ORDER BY k, p_brand) AS ord FROM m""")
def order_levels(spark, d):
    return out(gp.order_levels(read(spark, d, "part"), "p_brand", "p_retailprice"), digits=4)


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, min(struct_pack(k := l_shipdate, p := l_partkey, s := l_suppkey, f := l_returnflag)).f AS sp,
 coalesce(max(CASE WHEN l_discount > 0.07 THEN 1 WHEN l_discount > 0.03 THEN 0 END), 0) AS cones, max(l_quantity) AS dbh,
 max(CASE WHEN l_tax > 0.05 THEN 1 WHEN l_tax > 0.02 THEN 0 END) AS ser FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, sp, cones, dbh, CASE WHEN cones = 0 THEN NULL WHEN cones = 1 AND ser IS NULL THEN 0 ELSE ser END AS serotinous FROM r""")
def merge_split_records(spark, d):
    from ..operators.forest import merge_split_trees
    li = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("sp"), F.col("l_quantity").alias("dbh"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_returnflag").alias("part"),
        F.when(F.col("l_discount") > 0.07, 1).when(F.col("l_discount") > 0.03, 0).alias("cones"),
        F.when(F.col("l_tax") > 0.05, 1).when(F.col("l_tax") > 0.02, 0).alias("serotinous"))
    return merge_split_trees(li, ["l_orderkey", "l_linenumber"], "part")


@query("""
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE p_type IN ('SMALL', 'LARGE') AND p_size > 10 AND nullif(p_brand, 'Brand#5') IS NOT NULL""")
def filter_rows(spark, d):
    p = read(spark, d, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#5")))
    return p.filter(ms.member("p_type", ["SMALL", "LARGE"]) & (F.col("p_size") > 10) & F.col("b").isNotNull()).select(
        "p_partkey", "p_size", "p_retailprice")


@query(f"""
SELECT p_partkey, {R('p_size / 50.0')} AS p_size_rel, {R('p_retailprice / 50.0')} AS p_retailprice_rel FROM part""")
def across_template(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return out(rs.across(p, ["p_size", "p_retailprice"], lambda c: c / 50.0, "{col}_rel").drop("p_size", "p_retailprice"))


@query(f"""
SELECT e.event_id, {R('e.value - g.m')} AS reach FROM events e JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) g USING (event_type)""")
def join_to_centroid(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    g = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return out(jn.natural_inner(e, g).select("event_id", (F.col("value") - F.col("m")).alias("reach")))


@query("""
WITH p AS (SELECT c_name || '-' || c_mktsegment AS plot_id, c_nationkey AS x, floor(c_acctbal / 500) AS y FROM customer WHERE c_nationkey < 20),
v AS (SELECT c_name || '-' || c_mktsegment AS plot_id, CASE WHEN c_nationkey % 2 = 0 THEN '2019' ELSE '2020' END AS season FROM customer WHERE c_acctbal > 0),
n AS (SELECT coalesce(p.plot_id, v.plot_id) AS plot_id, season, x, y FROM p FULL JOIN v ON p.plot_id = v.plot_id WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY plot_id, season NULLS FIRST, x, y) AS plot_num FROM n)
SELECT plot_id, season, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, plot_num FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY plot_num) AS r FROM k) WHERE r = 1""")
def plot_matching(spark, d):
    from ..plans.survey import plots_with_points
    from ..sources.readers import point_layer
    c = read(spark, d, "customer").withColumns({"name": F.col("c_name"), "today": F.col("c_mktsegment")})
    pts = point_layer(c.filter("c_nationkey < 20").withColumn("y", F.floor(F.col("c_acctbal") / 500)), ["name", "today"], x="c_nationkey")
    visits = c.filter("c_acctbal > 0").select("name", "today", F.when(F.col("c_nationkey") % 2 == 0, "2019").otherwise("2020").alias("season"))
    return plots_with_points(pts, visits).select("plot_id", "season", "x", "y", "plot_num")
