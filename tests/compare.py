"""Run registered queries against DuckDB: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from opinara.plans import load_registry
from opinara.plans.fixtures import Tables
from opinara.session import local_session

NAMES = ("region nation customer supplier part orders lineitem events documents "
         "embeddings pages benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def check(spark, con, folder, name, q):
    """(status, detail, spark seconds, duckdb seconds)"""
    t0 = time.time()
    df = q.run(Tables(spark, folder))
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.sql is None:
        return "rows", f"{len(got)} rows", t1 - t0, 0.0
    cur = con.execute(q.sql)
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    t2 = time.time()
    c1, r1 = rows(df.columns, got)
    c2, r2 = rows(cols, want)
    if c1 != c2:
        return "BAD", f"columns {c1} | {c2}", t1 - t0, t2 - t1
    types = {f: (t, kinds[f]) for f, t in df.dtypes if t != kinds[f]}
    if r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
        return "BAD", f"rows {len(r1)} {len(r2)} {str(diff)[:900]}", t1 - t0, t2 - t1
    return ("TYPE" if types else "ok"), f"{len(r1)} rows {types or ''}", t1 - t0, t2 - t1


def main():
    args = sys.argv[1:]
    folder = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    picks = [a for a in args if not os.path.isdir(a)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, q in load_registry().items():
        if picks and not any(name == p or name.startswith(p + "_") for p in picks):
            continue
        try:
            status, detail, ts, td = check(spark, con, folder, name, q)
        except Exception as e:  # noqa: BLE001
            status, detail, ts, td = "ERR", f"{type(e).__name__} {str(e)[:700]}", 0, 0
        bad += status in ("BAD", "ERR")
        print(f"{status:5} {name:38} {ts:6.2f}s {td:6.2f}s {detail}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
