"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from tessera.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return norm_value(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm_value(v.asDict())
    if isinstance(v, bool):
        return int(v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir, name, fn, sql, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name}: spark={len(s_rows)} ({t1 - t0:.1f}s)"
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return f"SCHEMA {name}: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
    if len(a) != len(b):
        return f"COUNT {name}: spark={len(a)} duck={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"VALUES {name}: rows={len(a)} first diffs={diff} cols={sorted(s_cols)}"
    return f"OK    {name}: rows={len(a)} ({t1 - t0:.1f}s)"


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as E
    from tessera.session import get_session

    spark = get_session("local[8]")
    qs, ors = E.queries(), E.oracle_sql()
    keys = args or list(qs)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            line = compare(spark, sf_dir, k, qs[k], ors.get(k), con)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {k}: {type(e).__name__}: {str(e)[:400]}"
        if not (line.startswith("OK") or line.startswith("ROWS")):
            bad += 1
        print(line, flush=True)
    print(f"done: {len(keys)} keys, {bad} bad")


if __name__ == "__main__":
    main()
