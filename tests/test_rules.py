"""Hand-worked cases for the missing-value rules, reshaping, joins and grouping."""

import pytest
from pyspark.sql import functions as F

from regrove.functions import missing as ms
from regrove.operators import grouping as gp, joins as jn, reshape as rs


def one(df):
    return df.first()


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    got = {r["k"]: r for r in df.groupBy("k").agg(
        ms.strict_sum("x").alias("s"), ms.strict_mean("x").alias("m"), ms.skip_sum("x").alias("z"), ms.std_error("x").alias("e")).collect()}
    assert got["a"]["s"] is None and got["a"]["m"] is None and got["a"]["z"] == 1.0 and got["a"]["e"] is None
    assert got["b"]["s"] == 6.0 and got["b"]["m"] == 3.0 and got["b"]["e"] == pytest.approx(1.0)


def test_standard_error_counts_missing_rows(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (None,)], "x double")
    assert one(df.agg(ms.std_error("x").alias("e")))["e"] == pytest.approx(2 ** 0.5 / 2)


def test_half_even_zero_division_and_text(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(ms.round_even("x")).collect()] == [0.0, 2.0, 2.0]
    r = one(spark.range(1).select(
        ms.ratio(F.lit(0.0), F.lit(0.0), 0.0).alias("z"), ms.to_number(F.lit("abc")).alias("bad"), ms.to_number(F.lit("2.5")).alias("ok"),
        ms.paste(F.lit(None), F.lit(None), sep="-").alias("na")))
    assert r["z"] == 0.0 and r["bad"] is None and r["ok"] == 2.5 and r["na"] == "NA-NA"


def test_conditionals_with_unknowns(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-20.0,), (20.0,)], "x double")
    rows = df.select(ms.if_else(F.col("x") > 0, "p", "n").alias("s"), ms.cap("x", 10.0).alias("c"), ms.clamp("x", -10.0, 10.0, -11.0, 11.0).alias("k"),
                     ms.member("x", [5.0]).alias("m"), ms.row_min("x", F.lit(1.0)).alias("r")).collect()
    assert [r["s"] for r in rows] == [None, "p", "n", "p"]
    assert [r["c"] for r in rows] == [None, 5.0, -20.0, 10.0]
    assert [r["k"] for r in rows] == [None, 5.0, -11.0, 11.0]
    assert [r["m"] for r in rows] == [False, True, False, False]
    assert rows[0]["r"] is None


def test_class_edges(spark):
    df = spark.createDataFrame([(288.0,), (288.0001,), (-250000.0,), (20000.0,)], "v double")
    got = [r[0] for r in df.select(ms.classify("v", [(-250000, 288, 1), (288, 10000, None)])).collect()]
    assert got == [1.0, None, -250000.0, 20000.0]


def test_null_keys_match_once(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("k", 4), ("z", 5)], "k string, b int")
    want = {(None, 1, 3), ("k", 2, 4), ("z", None, 5)}
    assert {tuple(r) for r in jn.natural_full(a, b).collect()} == want


def test_melt_then_cast_round_trip(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3.0), (2, 4.0, 5.0, 6.0)], "id int, v_a_x double, v_a_y double, v_b_x double")
    long = rs.melt_parts(df, ["id"], ["v_a_x", "v_a_y", "v_b_x"], [None, "p", "q"])
    assert long.count() == 6  # missing cells stay as rows
    back = rs.cast_wide(long.withColumn("k", F.concat_ws("_", F.lit("v"), "p", "q")), ["id"], "k", ["v_a_x", "v_a_y", "v_b_x"], ["value"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_short_names_leave_parts_missing(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v_a double")
    assert one(rs.melt_parts(df, ["id"], ["v_a"], [None, "p", "q"]))["q"] is None


def test_records_equal_melt_and_cast(spark):
    df = spark.createDataFrame([(1, "PICO", "12.5", None, "7")], "id int, t_q1_1_sp string, t_q1_1_dbh string, t_q2_1_sp string, t_q2_1_dbh string")
    got = rs.melt_records(df, ["id"], df.columns[1:], [None, "quad", "num", "att"], "att").collect()
    assert {tuple(r) for r in got} == {(1, "q1", "1", "PICO", "12.5"), (1, "q2", "1", None, "7")}


def test_name_matching_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Pre_a int, pre_Note int, other int")
    assert rs.matching(df, prefixes=["PRE"], exclude_contains=["note"]) == ["Pre_a"]
    assert rs.column_range(df, "pre_Note", "other") == ["pre_Note", "other"]


def test_ties_survive_and_missing_weights_drop(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("p", "c", 0.5), ("q", "a", None)], "plot string, sp string, w double")
    assert {(r["plot"], r["sp"]) for r in gp.dominant(df, ["plot"], "w").collect()} == {("p", "a"), ("p", "b")}


def test_group_maximum_ignores_zero_groups(spark):
    df = spark.createDataFrame([("p", 0.0), ("q", 2.0), ("q", 2.0), ("q", 1.0)], "k string, v double")
    assert sorted(tuple(r) for r in gp.group_maximum(df, ["k"], "v").collect()) == [("q", 2.0), ("q", 2.0)]


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"))
    rows = gp.number_rows(df, ["v"], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in rows) and len(rows) == 5000


def test_index_starts_after_another_table(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "k string")
    base = spark.createDataFrame([(10,)], "m int")
    assert sorted(tuple(r) for r in gp.group_index(df, ["k"], "i", base).collect()) == [("a", 11), ("b", 12), ("b", 12)]


def test_first_row_per_key_is_by_order(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "k string, o int, v string")
    assert one(gp.first_per_key(df, ["k"], ["o"]))["v"] == "early"


def test_grid_is_completed(spark):
    df = spark.createDataFrame([("p", "pre", 1)], "plot string, time string, n int")
    got = {tuple(r) for r in jn.complete_grid(df, "plot", {"time": ["pre", "post"]}, {"n": 0}).collect()}
    assert got == {("p", "pre", 1), ("p", "post", 0)}
