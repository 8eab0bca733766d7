"""Run queries in Spark and their check SQL in DuckDB and compare values.

usage: python tools/check.py SF [name-or-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb  # noqa: E402

from matchloom import catalog  # noqa: E402
from matchloom.session import get_spark  # noqa: E402
from matchloom.sources.derived import BASE  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else f"{v + 0.0:.9g}")
    if isinstance(v, int):
        return ("i", v)
    if hasattr(v, "as_tuple"):
        return ("decimal", str(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "ROWS", f"{len(got)} rows", t1 - t0, 0.0
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(dcols):
        return "FAIL", f"columns {sorted(cols)} vs {sorted(dcols)}", t1 - t0, t2 - t1
    a, b = rows_of(cols, got), rows_of(dcols, want)
    if a == b:
        return ("OK" if a else "EMPTY"), f"{len(a)} rows", t1 - t0, t2 - t1
    sa, sb = set(a), set(b)
    only_a, only_b = [r for r in a if r not in sb][:3], [r for r in b if r not in sa][:3]
    return "FAIL", f"{len(a)} vs {len(b)}\n  {sorted(cols)}\n  spark {only_a}\n  duck  {only_b}", t1 - t0, t2 - t1


def main():
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    want = sys.argv[2:]
    spark, con = get_spark(cpus=8), connect(sf_dir)
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        try:
            status, msg, ts, td = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            status, msg, ts, td = "ERROR", str(e)[:900], 0.0, 0.0
        if status not in ("OK", "ROWS"):
            bad.append(name)
        print(f"{status:6} {name:24} spark {ts:6.2f}s duck {td:6.2f}s {msg}", flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
