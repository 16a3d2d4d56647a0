"""Run registered queries against their DuckDB oracle the way the driver does:
column names sorted, row count, order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], len(lines), hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in (names or list(sql)):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        res = con.execute(sql[name])
        dcols = [d[0] for d in res.description]
        drows = res.fetchall()
        t2 = time.time()
        sc, sn, sh, sl = digest(df.columns, srows)
        dc, dn, dh, dl = digest(dcols, drows)
        ok = sc == dc and sn == dn and sh == dh
        out[name] = ok
        if verbose:
            print(f"{name:36s} {'OK ' if ok else 'BAD'} rows {sn}/{dn} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
            if not ok:
                print("   cols", sc, dc)
                a, b = set(sl), set(dl)
                print("   spark-only", sorted(a - b)[:3])
                print("   duck-only ", sorted(b - a)[:3])
    return out


if __name__ == "__main__":
    from countmix.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    res = check(spark, sf, names)
    print(sum(res.values()), "of", len(res), "match")
