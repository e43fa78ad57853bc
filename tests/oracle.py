"""Compare registered queries with their DuckDB text: python tests/oracle.py [sf] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return bool(srows), f"rows={len(srows)} spark={t1 - t0:.1f}s (rows only)"
    cur = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    kinds = [(t[0], t[1]) for t in df.dtypes]
    note = f"rows={len(srows)}/{len(drows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if scols != dcols:
        return False, f"columns {scols} != {dcols}"
    if srows != drows:
        only_s = sorted(set(srows) - set(drows))[:3]
        only_d = sorted(set(drows) - set(srows))[:3]
        return False, f"{note}\n   spark only {str(only_s)[:900]}\n   duck only  {str(only_d)[:900]}"
    bad = [k for k in kinds if k[1].startswith(("decimal", "map", "struct", "variant"))]
    return True, note + (f" !types {bad}" if bad else "") + ("" if srows else " EMPTY")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from convspark.session import local

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if want and not any(w in name for w in want):  # no names: everything
            continue
        try:
            ok, note = compare(spark, con, sf_dir, fn, oracle.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok   " if ok else "FAIL "), name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
