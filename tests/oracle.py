"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or (isinstance(x, float) and x != x) else x)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str), ignore_index=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        x, y = a[c], b[c]
        for i, (p, q) in enumerate(zip(x, y)):
            if pd.isna(p) and pd.isna(q) if not isinstance(p, (list, dict)) and not hasattr(p, "__len__") else False:
                continue
            if str(p) != str(q) and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and p == q):
                bad = sum(1 for s, t in zip(x, y) if str(s) != str(t))
                return f"{c}[{i}]: {p!r} != {q!r} ({bad} of {len(a)} differ)"
    return None


def main(names: list[str], sf: str = "0.01") -> int:
    import __spark_entry__ as e
    from barlens.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in [n for n in qs if not names or any(n.startswith(x) for x in names)]:
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
        except Exception as ex:  # noqa: BLE001
            print(f"ERR  {name}: {str(ex)[:1500]}")
            failed += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s (no SQL)", flush=True)
            continue
        try:
            want = con.sql(sqls[name]).df()
        except Exception as ex:  # noqa: BLE001
            print(f"SQL  {name}: {str(ex)[:1500]}")
            failed += 1
            continue
        diff = compare(got, want)
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {name}: {len(got)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
              + (f"  {diff}" if diff else ""), flush=True)
        if len(got) == 0:
            print(f"     {name}: EMPTY")
    return failed


if __name__ == "__main__":
    sf = "0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf="):
        sf, args = args[0][3:], args[1:]
    sys.exit(main(args, sf))
