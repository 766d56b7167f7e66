"""Run the named queries on Spark and their SQL on DuckDB and compare rows.

    python check.py [folder] [name ...]
"""
import math
import sys
import time
from collections import Counter

import duckdb

from patronage.catalog import load
from patronage.sources.bindings import BASE
from patronage.session import local_session


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    if type(v).__name__ == "Decimal":
        return f"{v:.2f}"
    if type(v).__name__ == "datetime":
        return v.replace(tzinfo=None).isoformat()
    return str(v) if not isinstance(v, (int, str, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in data), sorted(columns)


def compare(spark, con, folder, name, fn, sql):
    started = time.time()
    df = fn(spark, folder)
    got, cols = rows(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{name:34s} rows={sum(got.values()):<7d} {took:5.1f}s (no SQL)"
    cur = con.execute(sql)
    want, want_cols = rows([d[0] for d in cur.description], cur.fetchall())
    ok = got == want and cols == want_cols
    text = f"{name:34s} rows={sum(got.values()):<7d} {took:5.1f}s {'ok' if ok else 'MISMATCH'}"
    if not ok:
        text += f"\n   cols {cols} vs {want_cols}\n   spark only {list((got - want).items())[:3]}\n   sql only   {list((want - got).items())[:3]}  (sql rows {sum(want.values())})"
    return ok, text


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = argv[1:] or list(queries)
    spark = local_session("check")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = []
    for name in names:
        try:
            ok, text = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{name:34s} ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(text, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} agree; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
