"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Columns are sorted by name and rows compared as multisets, like the driver.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((str(k), norm(x)) for k, x in v.items()))
    return repr(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(name, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        if name not in sql:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name:28s} rows-only n={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("oracle-error", str(e)[:400])
            if verbose:
                print(name, "ORACLE ERROR", str(e)[:400], flush=True)
            continue
        a, ca = rows_of(scols, srows)
        b, cb = rows_of(dcols, drows)
        ok = ca == cb and a == b
        results[name] = ("match" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name:28s} {'match' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} {ts:.1f}s", flush=True)
            if not ok:
                if ca != cb:
                    print("   cols", ca, cb)
                diff_a = [r for r in a if r not in set(b)][:3]
                diff_b = [r for r in b if r not in set(a)][:3]
                print("   spark-only", diff_a)
                print("   duck-only ", diff_b)
    return results


if __name__ == "__main__":
    from briskbi.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("match", "rows-only")}
    print("SUMMARY", len(res), "queries,", len(bad), "not matching:", sorted(bad))
