"""Compare registered queries with their DuckDB oracle: python check.py [sf_dir] [--skip-slow] [name-substring ...]"""

from __future__ import annotations

import importlib
import math
import sys
import time

import duckdb
import pandas as pd

from paysift.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False, name=None):
        out = []
        for v in r:
            if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
                out.append("∅")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                f = float(v)
                out.append(str(int(f)) if f == int(f) else repr(f))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[2:] if a != "--skip-slow"]
    slow = ("policy_", "stream_") if "--skip-slow" in sys.argv else ()
    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if name.startswith(slow) or (pats and not any(p in name for p in pats)):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            got = df.toPandas()
            took = time.time() - t
            if name not in oracle:
                print(f"ROWS  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cur = con.execute(oracle[name])
            want = cur.df()
            if sorted(got.columns) != sorted(want.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(got.columns)} vs {sorted(want.columns)}", flush=True)
                continue
            a, b = norm(got), norm(want)
            ok = a == b
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(a)} vs {len(b)} rows {took:.1f}s", flush=True)
            if not ok:
                sa, sb = set(a), set(b)
                print("   columns", sorted(got.columns))
                print("   only spark", sorted(sa - sb)[:3])
                print("   only duck ", sorted(sb - sa)[:3])
        except Exception as e:  # a broken query must not hide the others
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
