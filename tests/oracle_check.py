"""Run registered queries against their SQL in DuckDB: ``python tests/oracle_check.py [sf] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(canon(r[i]) for i in order) for r in rows])


def compare(name, df, sql, con):
    got = df.collect()
    gcols = df.columns
    cur = con.execute(sql)
    ocols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(gcols) != sorted(ocols):
        return f"columns {sorted(gcols)} != {sorted(ocols)}", len(got)
    a, b = rows_of(gcols, got), rows_of(ocols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {sorted(gcols)} {bad[0][0]} | {bad[0][1]}", len(got)
    return None, len(got)


def main():
    from __spark_entry__ import oracle_sql as oracles, queries
    from regrove.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(int(os.environ.get("C", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    q, o = queries(), oracles()
    fails = 0
    for name in (sys.argv[2:] or q):
        start = time.time()
        try:
            df = q[name](spark, folder)
            if name in o:
                err, n = compare(name, df, o[name], con)
            else:
                err, n = None, len(df.collect())
        except Exception as e:  # report and go on
            err, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        fails += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name:28s} {n:8d} rows {time.time() - start:6.2f}s {'' if name in o else '(rows only)'} {err or ''}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
