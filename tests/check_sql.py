"""Compare registered queries with their SQL: ``python tests/check_sql.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from strataudit.plans.inputs import TABLES  # noqa: E402
from strataudit.session import local_session  # noqa: E402


def tables_in(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr), [names[i] for i in order]


def compare(spark, con, folder: str, name: str, verbose: bool = False) -> str:
    """Empty if the query and its SQL give the same rows."""
    df = entry.queries()[name](spark, folder)
    got, cols = _plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    want, want_cols = _plain(cur.fetchall(), [d[0] for d in cur.description])
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if got == want:
        return ""
    if verbose:
        a, b = set(map(repr, got)), set(map(repr, want))
        for mark, only in (("spark", a - b), ("sql", b - a)):
            for row in sorted(only)[:2]:
                print(f"  {mark}: {row[:400]}")
    return f"{len(got)} / {len(want)} rows differ"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), tables_in(folder)
    bad = 0
    for name in names:
        start = time.time()
        if name not in entry.oracle_sql():
            print(f"{name}: no SQL")
            continue
        try:
            problem = compare(spark, con, folder, name, verbose=True)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
