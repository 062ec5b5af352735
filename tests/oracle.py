"""Runs queries and their SQL side by side: ``python -m tests.oracle [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql: str) -> str:
    """Empty when names, types of values, row count and values agree; else what differs."""
    names = sorted(df.columns)
    ours = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(n) for n in names]
    theirs = [tuple(_cell(r[i]) for i in at) for r in cur.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if not ours:
        return "no rows"
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    bad = []
    for a, b in zip(order(ours), order(theirs)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad.append((a, b))
    return f"{len(bad)} rows differ {names}, first: {bad[0]}" if bad else ""


def main() -> None:
    from flowquarry.plans.catalog import ORACLE, QUERIES
    from flowquarry.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = str(DATA / f"sf{sf}")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                said = compare(df, con, ORACLE[name])
                result = "ok" if not said else f"DIFF {said}"
            else:
                result = f"rows {df.count()}"
        except Exception as e:  # report and go on to the next query
            result = f"ERROR {str(e)[:600]}"
        failed += result.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - started:6.1f}s {result}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} fine")


if __name__ == "__main__":
    main()
