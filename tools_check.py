"""Compare registered queries with their SQL in DuckDB: python tools_check.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from checks import ORACLES, QUERIES
from wavecairn.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind in "iub":
            df[c] = df[c].astype(float)
        elif kind == "O":
            numeric = pd.to_numeric(df[c], errors="coerce")
            text = df[c].map(lambda v: None if v is None or v is pd.NA else v)
            df[c] = numeric.astype(float) if len(df) and numeric.notna().sum() == text.notna().sum() and not text.map(lambda v: isinstance(v, str)).any() else text.astype("string").fillna("<null>")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = normal(a), normal(b)
    for c in a.columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
        else:
            bad = np.array([str(p) != str(q) for p, q in zip(x, y)], dtype=bool)
        if bad.any():
            k = int(np.flatnonzero(bad)[0])
            return f"column {c}: {int(bad.sum())} differ, first {x[k]!r} != {y[k]!r}"
    return ""


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = duck(sf), 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            start = time.time()
            got = QUERIES[name](spark, sf).toPandas()
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                want = con.execute(ORACLES[name]).df()
                problem = compare(got, want)
                note = f"duck {time.time() - start:.2f}s"
            else:
                problem, note = "", "rows only"
        except Exception as error:  # noqa: BLE001
            problem, took, note, got = f"{type(error).__name__}: {str(error)[:600]}", 0.0, "", []
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={len(got):7d} {took:6.2f}s {note} {problem}", flush=True)
    print("failures:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
