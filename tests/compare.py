"""Run catalogue queries against their SQL oracles.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return df.sort_values(by=list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def mismatch(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None if equal as multisets of rows, else a short description."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)

    def rows(df):
        return [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in df.itertuples(index=False)]

    ra, rb = sorted(rows(a), key=repr), sorted(rows(b), key=repr)
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tablemend.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, sqls, bad = local_session(8), oracle(sf_dir), oracle_sql(), []
    for name in names:
        t = time.time()
        try:
            ours = queries()[name](spark, sf_dir).toPandas()
            spent = time.time() - t
            t = time.time()
            note = mismatch(ours, con.sql(sqls[name]).df()) if name in sqls else f"no oracle, {len(ours)} rows"
            bad += [name] if note and name in sqls else []
            print(f"{name:28s} {len(ours):7d} rows {spent:6.1f}s / {time.time() - t:5.1f}s  {note or 'ok'}", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"{name:28s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
