"""Run registered queries against their SQL and report differences.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    cols = sorted(got.columns)
    if cols != sorted(want.columns):
        return f"columns {cols} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"

    def canon(df: pd.DataFrame) -> list:
        rows = zip(*[[_plain(x) for x in df[c].tolist()] for c in cols], strict=True)
        return sorted(rows, key=repr)

    a, b = canon(got), canon(want)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} rows differ; {cols}; first: spark {bad[0][0]} sql {bad[0][1]}"[:1500]
    for c in cols:
        filled = got[c].notna().any() and want[c].notna().any()  # pandas has no type for NULLs only
        whole = got[c].isna().any() and pd.api.types.is_float_dtype(got[c]) and (got[c].dropna() % 1 == 0).all()
        if (got[c].dtype.kind in "iu" or whole) != (want[c].dtype.kind in "iu") and filled:  # with NULLs, whole numbers arrive as floats
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    return None


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    return x


def main() -> int:
    from conftest import make_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(entry.queries())
    spark = make_session()
    con = duck(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name in names:
        t = time.time()
        try:
            got = entry.queries()[name](spark, folder).toPandas()
            took = time.time() - t
            problem = None
            if name in sql:
                problem = differences(got, con.sql(sql[name]).df())
            state = "no sql" if name not in sql else ("ok" if problem is None else "DIFF")
        except Exception as e:  # report and go on with the next query
            state, problem, got, took = "ERROR", str(e)[:1500], [], time.time() - t
        failed += problem is not None
        print(f"{state:7s} {name:32s} {len(got):8d} rows {took:6.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
