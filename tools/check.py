"""Runs registered queries in Spark and their SQL in DuckDB on the same tables and compares them."""

from __future__ import annotations

import argparse
import importlib.util
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None or v is pd.NA:
        return ""
    if isinstance(v, float):
        # pandas reads whole numbers with nulls as floats
        return "" if v != v else str(int(v)) if v.is_integer() else repr(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return str([cell(x) for x in v.tolist()])
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--no-sql", action="store_true")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from tidewatch.runtime import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            got = fn(spark, args.sf).toPandas()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:1500]}")
            continue
        took = time.time() - t0
        if name not in sql or args.no_sql:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s")
            continue
        try:
            t1 = time.time()
            want = con.sql(sql[name]).df()
            oracle = time.time() - t1
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(error)[:1500]}")
            continue
        if sorted(got.columns) != sorted(want.columns):
            bad += 1
            print(f"COLS  {name}: {sorted(got.columns)} vs {sorted(want.columns)}")
            continue
        a, b = rows_of(got), rows_of(want)
        if a == b:
            kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
            print(f"ok    {name}: {len(a)} rows, {took:.1f}s, sql {oracle:.1f}s {kinds or ''}")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; only spark {len(sa - sb)}, only sql {len(sb - sa)}")
            print("   cols", sorted(got.columns))
            for r in sorted(sa - sb)[:3]:
                print("   spark", r)
            for r in sorted(sb - sa)[:3]:
                print("   sql  ", r)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
