"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: ``python tests/oracle.py FOLDER [NAME ..]``.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if v is None or isinstance(v, str):
        return v
    return float(v)


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, statement: str) -> tuple[bool, str]:
    result = con.execute(statement)
    want_cols, want = rows([d[0] for d in result.description], result.fetchall())
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        ours, theirs = set(got), set(want)
        only = [sorted(x, key=repr)[:3] for x in (ours - theirs, theirs - ours)]
        return False, f"{len(got)} rows, expected {len(want)}; only ours {only[0]}; SQL {only[1]}"
    return True, f"{len(got)} rows"


def main() -> None:
    from tests.session import make_session
    from workload import ORACLES, QUERIES

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    failed = []
    for name in names or list(QUERIES):
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                ok, note = compare(df, con, ORACLES[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as error:  # keep going: report every query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - started:6.2f}s {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
