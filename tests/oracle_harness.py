"""Local twin of the driver's correctness gate: run a catalog query in Spark and its SQL in
DuckDB over the same parquet files, then compare row count, column names and the multiset of
rows.  Usable from pytest and from the command line:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False

SPARK_TO_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP", "decimal": "DECIMAL", "float": "FLOAT"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v) if EXACT else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v) if not isinstance(v, (int, bool)) else v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    s_cols = sdf.columns
    s_types = dict(sdf.dtypes)
    d_types = {d[0]: str(d[1]) for d in res.description}
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_cols
                 if c in d_types and SPARK_TO_DUCK.get(s_types[c].split("(")[0]) != d_types[c].split("(")[0]}
    out = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(s_rows), len(d_rows))}
    if sorted(s_cols) != sorted(d_cols):
        out["ok"] = False
        out["why"] = f"columns {sorted(s_cols)} vs {sorted(d_cols)}"
        return out
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    cs = Counter(tuple(_norm(r[i]) for i in order_s) for r in s_rows)
    cd = Counter(tuple(_norm(r[i]) for i in order_d) for r in d_rows)
    out["ok"] = cs == cd
    if type_diff:
        out["type_diff"] = type_diff
    if not out["ok"]:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        out["why"] = f"spark-only {only_s} duck-only {only_d} (n diff {sum((cs - cd).values())})"
    return out


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tickweave.session import get_session
    global EXACT
    if "--exact" in argv:
        EXACT = True
        argv = [a for a in argv if a != "--exact"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"-- {name}: rows-only {n} ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + str(r), flush=True)
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
