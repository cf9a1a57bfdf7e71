"""Ranks of many columns from one range-sorted melt, against pandas."""

import random

import pandas as pd
import pytest

from regrove.operators import hypothesis as hy, ranks


@pytest.mark.parametrize("batch, parts", [(7, 6), (10_000, 3), (64, 1)])
def test_ranks_of_many_columns(spark, batch, parts):
    rng = random.Random(batch)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([5, 5, 5, rng.randint(-3, 40), 2**60 + rng.randint(0, 3), None]),
             rng.choice([0.0, -0.0, 1.5, rng.random(), None, float("nan")])) for _ in range(900)]
    rows += [("one", 1, 2.0), ("two", 7, 7.0), ("two", 7, 7.0)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, (batch, parts, "false")):
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "k string, i long, f double").selectExpr("*", "cast(i % 7 as decimal(9, 2)) as d")
        base = ranks.numbered_rows(df)
        for keys in ([], ["k"]):
            got = base.join(ranks.rank_columns(base, keys, ["i", "f", "d"]), ranks.ROW, "left").toPandas()
            for c in ("i", "f", "d"):
                plain = pd.DataFrame({"k": got["k"].fillna("~"), "v": [None if v is None or v != v else v for v in base.select(c, ranks.ROW).toPandas().set_index(
                    ranks.ROW)[c].reindex(got[ranks.ROW])]})
                exact = {r[ranks.ROW]: r[c] for r in base.select(c, ranks.ROW).collect()}
                order = sorted({exact[r] for r in got[ranks.ROW] if exact[r] is not None and exact[r] == exact[r]})
                plain["v"] = [order.index(exact[r]) if exact[r] is not None and exact[r] == exact[r] else None for r in got[ranks.ROW]]
                want = plain.groupby("k")["v"].rank() if keys else plain["v"].rank()
                assert got[f"rank_{c}"].fillna(-1).tolist() == want.fillna(-1).tolist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a long, b double")
    base = ranks.numbered_rows(df)
    assert sorted((r.rank_a, r.rank_b) for r in ranks.rank_columns(base, [], ["a", "b"]).collect()) == [(None, 1.0), (None, 2.0)]
    assert hy.spearman_matrix(df.limit(0), ["a", "b"]).first()["rho"] is None


@pytest.mark.parametrize("held, batch", [(1, 3), (4, 7), (30, 64)])
def test_ties_longer_than_what_is_held(monkeypatch, held, batch):
    """A partition's ties in its first, middle and last place: batches stay small, ranks are whole."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    monkeypatch.setattr(ranks, "HELD", held)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    for sizes in ([(1, 100)], [(1, 90), (1, 1), (1, 80)], [(1, 2), (1, 100), (1, 3), (2, 70), (2, 1), (2, 90)], [(1, 1), (2, 200), (3, 1)], [(1, 64), (2, 64)]):
        g = np.repeat([g for g, _ in sizes], [n for _, n in sizes])
        v = np.repeat(np.arange(len(sizes)), [n for _, n in sizes])
        whole = pa.RecordBatch.from_pydict({ranks.ROW: np.arange(len(g)), "var": np.zeros(len(g), np.int32), "g": g, "v": v})
        out = list(ranks._number(whole.slice(i, batch) for i in range(0, len(g), batch)))
        assert max(o.num_rows for o in out) <= held + 2 * batch + 2
        rows = pa.Table.from_batches(out).to_pandas()
        ends, got = rows[rows["g"].notna()].set_index("zone"), rows[rows["g"].isna()].sort_values(ranks.ROW)
        (_, shift, first, last), = ranks.partition_shifts([(0, z, *map(int, ends.loc[z, ["g", "v", "in_group", "in_tie"]])) for z in (2, 3)])
        assert shift == 0.0
        known = {2: first, 3: last} | {z: last if r["g"] == ranks.LAST_TIE else r["place"] for z, r in ends.iterrows() if z > 3}
        want = pd.DataFrame({"g": g, "v": v}).groupby("g")["v"].rank().tolist()
        assert [known.get(z, p) for z, p in zip(got["zone"], got["place"])] == want


def test_matrix_with_ties_longer_than_what_is_held(spark):
    """Ten values tied over 60,000 rows each; each partition begins and ends within one."""
    df = spark.range(600_000).selectExpr("id % 10 as a", "(id * 7919) % 1000003 as b", "cast((id * 31) % 4 as double) as c")
    base = ranks.numbered_rows(df.repartition(3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = base.join(ranks.rank_columns(base, [], ["a", "b", "c"]), ranks.ROW).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in "abc":
        assert (got[f"rank_{c}"] == got[c].rank()).all()


def test_shifts_of_ties_over_partitions():
    # value 5 of group 1 fills partition 0's end, all of 1, and 2's beginning
    ends = [(0, 2, 1, 4, 10, 3), (0, 3, 1, 5, 10, 7), (1, 2, 1, 5, 20, 20), (1, 3, 1, 5, 20, 20), (2, 2, 1, 5, 4, 4), (2, 3, 2, 9, 6, 2)]
    assert ranks.partition_shifts(ends) == [(0, 0.0, 2.0, 3 + 32 / 2), (1, 10.0, 3 + 32 / 2, 3 + 32 / 2), (2, 30.0, 3 + 32 / 2, 4 + 1.5)]


def test_partitions_follow_the_rows(spark, monkeypatch):
    """No partition of the sorted rows grows with the table, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr(ranks, "PART_ROWS", 500)
    tables, before = [], ranks.staged
    monkeypatch.setattr(ranks, "staged", lambda df, label: tables.append((label, before(df, label))) or tables[-1][1])
    df = spark.range(6000).selectExpr("id % 5 as a", "cast((id * 7919) % 6007 as double) as b")
    base = ranks.numbered_rows(df)
    got = base.join(ranks.rank_columns(base, [], ["a", "b"]), ranks.ROW).toPandas()
    for c in "ab":
        assert (got[f"rank_{c}"] == got[c].rank()).all()
    sizes = dict(tables)["placed"].filter("g is null").groupBy("part").count().collect()
    assert len(sizes) > 12 and max(r["count"] for r in sizes) < 2000
