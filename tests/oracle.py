"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, path):
    """Return an error text, or '' when columns, row count and every value agree."""
    df = fn(spark, path)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; cols {sorted(cols)}; first: {bad[0]}"
    return "" if got else "EMPTY on both sides"


def main():
    from __spark_entry__ import oracle_sql, queries
    from mnemoframe.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pre = tuple(sys.argv[2:]) or ("",)
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(path)
    sqls, bad, n = oracle_sql(), 0, 0
    for name, fn in queries().items():
        if not name.startswith(pre):
            continue
        n += 1
        t0 = time.time()
        try:
            err = compare(spark, con, name, fn, sqls.get(name), path)
        except Exception as e:  # report and go on
            err = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(err)
        if err or time.time() - t0 > 4 or os.environ.get("VERBOSE"):
            print(f"{'FAIL' if err else 'ok'} {name} {time.time() - t0:.1f}s {'(rows only)' if name not in sqls else ''} {err[:1100]}", flush=True)
    print(f"{n - bad}/{n} agree")


if __name__ == "__main__":
    main()
